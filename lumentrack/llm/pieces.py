"""Encoding with merged pieces (a SentencePiece BPE model) by each prefix's unique last token.

A pair of symbols may merge if their concatenation is a piece; better scores first, the leftmost of equals. So each
prefix of a text has one valid encoding and one valid last token. An automaton over all pieces lists the tokens that
end at each character; of these the longest that may stand behind the last token of the prefix before it is the one.
Whether it may is tested on the pair alone. The ids are then read off the table backwards.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrack.llm.bpe import BATCH_CHARS, MEMO_PAIRS, RUN_PIECES, runs

#: The sign that stands for a space within pieces.
SPACE = "▁"
#: Longer stretches aren't remembered; of the others so many in each of two generations.
SHORT_CHARS, MEMO_PIECES = 48, 180_000


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    assert isinstance(error, UnicodeDecodeError)
    return "�", error.start + 1


class Pieces:
    """The pieces of a model file: BPE with byte fallback, no normalisation, a space put before each text.

    Raises ValueError for models of another kind.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(model.get_piece_size())
        self.token = [model.id_to_piece(i) for i in kinds]
        silent = {i for i in kinds if model.is_control(i)}
        of_bytes = {i for i in kinds if model.is_byte(i)}
        normal = [i for i in kinds if i not in silent | of_bytes and not model.is_unknown(i)]
        if len(of_bytes) != 256 or any(model.is_unused(i) for i in kinds) or model.normalize("  a  ﬁ") != f"{SPACE}{SPACE}{SPACE}a {SPACE}ﬁ":
            raise ValueError(f"{path} isn't a model of pieces with byte fallback, a space before and no normalisation")
        self.end_id = model.eos_id()
        self.byte_id = [0] * 256
        for i in of_bytes:
            self.byte_id[int(self.token[i][3:5], 16)] = i
        #: What each id stands for in UTF-8; control ids stand for nothing.
        self.data = [b"" if i in silent else bytes([int(t[3:5], 16)]) if i in of_bytes else t.replace(SPACE, " ").encode() for i, t in enumerate(self.token)]
        self.data[model.unk_id()] = " ⁇ ".encode()
        self.silent, self.length = np.array([i in silent for i in kinds]), np.array([len(d) for d in self.data])
        self.flat, self.start = np.frombuffer(b"".join(self.data), np.uint8), np.cumsum(self.length) - self.length
        self.ids = {self.token[i]: i for i in normal}
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {self.token[i]: order[model.get_score(i)] for i in normal}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self._built(piece):
                self.automaton.add_word(piece, self.ids[piece])
        self.automaton.make_automaton()
        self._chars = [len(t) for t in self.token]
        self.chars = np.array(self._chars)
        known = set("".join(self.ids))
        if lost := known - self.ids.keys():
            raise ValueError(f"characters without a piece of their own: {sorted(lost)[:5]}")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space within it")
        self.stretches = self._borders()
        self.unknown = re.compile("([^" + "".join(re.escape(c) for c in sorted(known)) + "]+)")
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _borders(self) -> re.Pattern:
        """Cuts texts where no piece reaches across: before spaces, about characters that no longer piece has, and before
        signs that in pieces follow none but such signs (a comma never follows a letter)."""
        bound = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in bound)
        before: dict[str, set[str]] = {c: set() for c in bound}
        for p in self.ids:
            for a, b in pairwise(p):
                before[b].add(a)
        signs = {c for c in bound if not c.isalpha() and c != SPACE}
        while wrong := {c for c in signs if not before[c] <= signs | {SPACE}}:
            signs -= wrong
        sign = f"[{''.join(re.escape(c) for c in sorted(signs))}]" if signs else "(?!)"
        other = f"[^{SPACE}{alone}{sign[1:-1] if signs else ''}]"
        return re.compile(f"{SPACE}*+(?:{sign}++{other}*+|{other}++)|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def _built(self, piece: str) -> bool:
        """Whether the merges, run on a piece's own characters, give it back; notes the two that its last merge joins."""
        parts = list(piece)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(self.rank):
                return False
            if len(parts) == 2:
                if max(self.rank[p] if len(p) > 1 else -1 for p in parts) > best:
                    raise ValueError(f"{piece!r} would be merged before its parts")
                self.halves[piece] = parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def merged(self, stretch: str) -> list[str]:
        """The definition: merge the adjacent pair of best score, the leftmost of equals, until none is a piece."""
        parts = list(stretch)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: at no time before both are whole does a merge across their border come first.

        The symbols on either side of the border are followed back in time, the later merge undone first; of equal
        merges the right one is later.
        """
        left, right, rank_of = self.token[a], self.token[b], self.rank.get
        never = len(self.rank)
        till_left = till_right = never
        known = True
        while True:
            rank = rank_of(left + right)
            if rank is not None and rank < till_left and rank <= till_right:
                known = False
                break
            made_left = rank_of(left, -1) if len(left) > 1 else -1
            made_right = rank_of(right, -1) if len(right) > 1 else -1
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:
                till_left, left = made_left, self.halves[left][1]
            else:
                till_right, right = made_right, self.halves[right][0]
        if len(self._fits) >= MEMO_PAIRS:
            self._fits.clear()
        self._fits[a << 24 | b] = known
        return known

    def last_tokens(self, stretch: str) -> array:
        """The unique last token of each prefix of a stretch of known characters."""
        last = array("i", bytes(4 * len(stretch)))
        fits, known, chars = self.fits, self._fits.get, self._chars
        done = -1
        for end, token in self.automaton.iter(stretch):  # longest first at each end
            if end == done:
                continue
            n = chars[token]
            if n <= end:
                before = last[end - n]
                fit = known(before << 24 | token)
                if fit is None:
                    fit = fits(before, token)
                if not fit:
                    continue
            last[end] = token
            done = end
        return last

    def walk(self, last: array) -> list[int]:
        """The ids that the table of last tokens spells, read backwards."""
        out, at, token = [], len(last) - 1, self.token
        while at >= 0:
            out.append(last[at])
            at -= len(token[last[at]])
        out.reverse()
        return out

    def _spelled(self, stretch: str) -> bytes:
        out: list[int] = []
        for k, part in enumerate(self.unknown.split(stretch)):
            if k % 2:
                out += map(self.byte_id.__getitem__, part.encode())
            elif part:
                out += self.walk(self.last_tokens(part))
        return np.array(out, "<u4").tobytes()

    def _table(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last tokens of all prefixes of short stretches set end to end, or -1, and where each starts and how long it is.

        All prefixes of one length are filled together, the longest tokens first.
        """
        size = np.array([len(s) for s in stretches])
        start = np.cumsum(size) - size
        match = np.fromiter(chain.from_iterable(self.automaton.iter("".join(stretches))), np.int64).reshape(-1, 2)
        end, token = match[:, 0], match[:, 1]
        n = self.chars[token]
        at = end - np.repeat(start, size)[end]
        within = n <= at + 1
        end, token, n, at = end[within], token[within], n[within], at[within]
        widest = int(self.chars.max()) + 1
        key = (at * widest + widest - n).astype(np.int16 if SHORT_CHARS * widest < 1 << 15 else np.int64)
        order = np.argsort(key, kind="stable")
        end, token, n, at, key = end[order], token[order], n[order], at[order], key[order]
        bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        last = np.full(int(size.sum()), -1, np.int64)
        for a, b in pairwise(bounds.tolist()):
            where, which = end[a:b], token[a:b]
            free = last[where] < 0
            where, which = where[free], which[free]
            if n[a] <= at[a] and len(where):
                before = last[where - n[a]]
                pair, inverse = np.unique(before << 24 | which, return_inverse=True)
                fit = np.array([p >= 0 and (self.fits(p >> 24, p & 0xFFFFFF) if (k := self._fits.get(p)) is None else k) for p in pair.tolist()], bool)[inverse]
                where, which = where[fit], which[fit]
            last[where] = which
        return last, start, size

    def _short(self, stretches: list[str]) -> list[bytes]:
        """The ids of short stretches, read off the table backwards, all of them a token at a time."""
        last, start, size = self._table(stretches)
        strange = np.unique(np.searchsorted(start, np.flatnonzero(last < 0), "right") - 1)
        left = size.copy()
        left[strange] = 0
        row, back = np.flatnonzero(left), []
        while len(row):
            token = last[start[row] + left[row] - 1]
            back.append((row, token))
            left[row] -= self.chars[token]
            row = row[left[row] > 0]
        count = np.zeros(len(stretches), np.int64)
        for row, _ in back:
            count[row] += 1
        till = np.cumsum(count)
        ids = np.empty(int(count.sum()), "<u4")
        for k, (row, token) in enumerate(back):
            ids[till[row] - 1 - k] = token
        packed = ids.tobytes()
        out = [packed[4 * a : 4 * b] for a, b in pairwise([0, *till.tolist()])]
        for i in strange.tolist():  # with characters that no piece has
            out[i] = self._spelled(stretches[i])
        return out

    def _known(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of each stretch. Two generations of short ones are remembered, the older is forgotten."""
        if len(self._memo) >= MEMO_PIECES:
            self._memo, self._older = {}, self._memo
        memo, older = self._memo, self._older
        new = stretches - memo.keys()
        for s in new & older.keys():
            memo[s] = older[s]
        new -= older.keys()
        short = [s for s in new if len(s) <= SHORT_CHARS]
        for i in range(0, len(short), 1 << 15):
            block = short[i : i + (1 << 15)]
            memo.update(zip(block, self._short(block), strict=True))
        return memo | {s: self._spelled(s) for s in new if len(s) > SHORT_CHARS} if len(short) < len(new) else memo

    def encode(self, text: str, first: bool = True) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. ``first``: it is no later part of a text."""
        if not text:
            return b""
        marked = text.replace(" ", SPACE)
        if first:
            marked = SPACE + marked
        if len(marked) <= BATCH_CHARS:
            found = self.stretches.findall(marked)
            return b"".join(map(self._known(set(found)).__getitem__, found))
        matches, parts = self.stretches.finditer(marked), []
        while run := [m.group() for m in islice(matches, RUN_PIECES)]:
            parts.append(b"".join(map(self._known(set(run)).__getitem__, run)))
        return b"".join(parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new stretches of a batch are spelled once."""
        out: list[bytes] = []
        lists: list[list[str]] = []

        def close() -> None:
            ids = self._known(set().union(*lists)).__getitem__
            out.extend(b"".join(map(ids, stretches)) for stretches in lists)
            lists.clear()

        chars = 0
        for text in texts:
            if len(text) >= BATCH_CHARS:
                close()
                out.append(self.encode(text))
                chars = 0
                continue
            lists.append(self.stretches.findall(SPACE + text.replace(" ", SPACE)) if text else [])
            chars += len(text)
            if chars > BATCH_CHARS:
                close()
                chars = 0
        close()
        return out

    def spelled_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, the space before the text included; gathered for some thousands of ids at once."""
        parts = []
        for i in range(0, len(ids), 1 << 18):
            block = ids[i : i + (1 << 18)]
            n = self.length[block]
            at = np.repeat(self.start[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts.append(self.flat[at].tobytes())
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """The text of ids: control ids are silent, the space before it goes, bytes that are no UTF-8 become U+FFFD each."""
        ids = np.frombuffer(packed, "<u4")
        ids = ids[~self.silent[ids]]
        data = self.spelled_bytes(ids)
        if len(ids) and self.token[ids[0]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="lumentrack-each-byte")


codecs.register_error("lumentrack-each-byte", _each_byte)
_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """Loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(text: Column, path: str) -> Column:
    """The ids of each whole text as little-endian unsigned 32-bit integers, without an end id; null counts as empty."""

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = loaded(path)
        for texts in batches:
            yield pa.array(v.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The texts that ids (as ``encoded`` gives them) stand for."""

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = loaded(path)
        for packed in batches:
            yield pa.array([v.decode(b or b"") for b in packed.to_pylist()], pa.string())

    return decode(ids)


def encoding_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens (the end id included), ids_sha256 of the decimal ids, decoded_sha256.

    Null text counts as empty and has the end id only. Texts of any length are taken in runs of pieces; only digests
    leave the task that reads a text. Repeated rows are encoded alike; an empty table gives an empty result; other
    columns aren't read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded(path)
        decimal = [str(i) for i in range(len(v.token))].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        end = np.array([v.end_id], "<u4").tobytes()
        for whole in batches:
            for batch in runs(whole):
                packed = [ids + end for ids in v.encode_all([t or "" for t in batch.column(1).to_pylist()])]
                n = pa.array([len(p) // 4 for p in packed], pa.int64())
                spelled = pa.array([sha(" ".join(map(decimal, np.frombuffer(p, "<u4").tolist()))) for p in packed])
                yield pa.RecordBatch.from_arrays([batch.column(0), n, spelled, pa.array([sha(v.decode(p)) for p in packed])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

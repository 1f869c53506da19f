"""Byte-level BPE by dynamic programming over prefixes.

Each prefix of a piece has one valid encoding, and so one valid last token. A token may follow the last token of
the prefix before it only if the merges, run on the two tokens' bytes alone, give back the same two tokens. Keeping
every prefix's last token makes appending exact, and lets an edit reuse all that stands before it. The pieces of a
batch that weren't met before take a byte at a time together.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of up to so many bytes are encoded together, longer ones alone.
SHORT_BYTES = 48
#: Memory bounds of a worker: so many short pieces are known in each of two generations, and of so many pairs whether they fit.
MEMO_PIECES, MEMO_PAIRS = 200_000, 500_000
#: Texts are encoded together up to about so many characters, a longer text in runs of so many pieces.
BATCH_CHARS, RUN_PIECES = 2_000_000, 400_000


class Vocabulary:
    """Tokens by rank, from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        self.ending: dict[bytes, list[int]] = {}
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) > 2 and len(token) not in (lengths := self.ending.setdefault(token[-3:], [])):
                lengths.append(len(token))
        for lengths in self.ending.values():
            lengths.sort(reverse=True)
        # White space as the rank files' own library has it: U+001C to U+001F aren't.
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")
        # No word or number begins as an ending does, so the commonest alternatives may be tried first.
        endings, words = "'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+| ?\p{N}+|"
        self.pieces = regex.compile(words + endings + pattern[len(endings + words) :] if pattern.startswith(endings + words) else pattern)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens])
        self.start = np.cumsum(self.length) - self.length
        self._grow_tree()
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _grow_tree(self) -> None:
        """All tokens read backwards as a tree: sorted edges (node x 256 + byte), where they lead, and the token that a node ends, or -1."""
        edges: dict[int, int] = {}
        ends = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in reversed(token):
                node = edges.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = rank
        self.edges = np.sort(np.fromiter(edges, np.int64, len(edges)))
        self.leads = np.array([edges[e] for e in self.edges.tolist()], np.int32)
        self.ends = np.array(ends, np.int32)
        # The first two steps are the commonest by far: nodes by last byte, and by the last two, or -1.
        ways = np.arange(1 << 16)
        self.first = np.array([edges.get(b, -1) for b in range(256)], np.int64)
        at = np.minimum(np.searchsorted(self.edges, edge := self.first[ways >> 8] << 8 | ways & 255), len(self.edges) - 1)
        self.second = np.where((self.first[ways >> 8] >= 0) & (self.edges[at] == edge), self.leads[at], -1).astype(np.int64)

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, the leftmost of equals, until none is a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last of a token's own merges joins."""
        known = self._halves.get(token)
        if known is None:
            data, ranks = self.tokens[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._halves[token] = ranks[parts[0]], ranks[parts[1]]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge joins the two before those within them are done.

        The tokens on either side of the border are followed back in time, the later merge undone first. Two that stand
        there together are joined if their rank comes before that of the merge which takes one of them, and on equal
        ranks if that merge is to the right.
        """
        key = a << 20 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        tokens, rank_of = self.tokens, self.ranks.get
        left, right, known = tokens[a], tokens[b], True
        till_a = till_b = len(tokens)
        while True:
            rank = rank_of(left + right)
            if rank is not None and rank < till_a and rank <= till_b:
                known = False
                break
            if len(left) > 1 and (a > b or len(right) == 1):
                till_a, a = a, self.halves(a)[1]
                left = tokens[a]
            elif len(right) > 1:
                till_b, b = b, self.halves(b)[0]
                right = tokens[b]
            else:
                break
        if len(self._fits) >= MEMO_PAIRS:
            self._fits.clear()
        self._fits[key] = known
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The valid last token of data[:end], where ``last`` has those of all shorter prefixes."""
        ranks = self.ranks
        for n in (*self.ending.get(data[max(0, end - 3) : end], ()), 2, 1):
            if n <= end and (rank := ranks.get(data[end - n : end])) is not None and (n == end or self.fits(last[end - n - 1], rank)):
                return rank
        raise ValueError(f"no token ends the prefix {data[:end]!r}")

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last`` has the last token of each prefix of data[: len(last)]; it grows to all of ``data``."""
        for end in range(len(last) + 1, len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def last_tokens(self, pieces: list[bytes]) -> np.ndarray:
        """Row i, column e: the valid last token of pieces[i][:e]. The pieces come longest first."""
        width = len(pieces[0])
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        lengths = np.array([len(p) for p in pieces])
        last = np.zeros((len(pieces), width + 1), np.int32)
        for end in range(1, width + 1):
            rows = np.arange(np.searchsorted(-lengths, -end, "right"))
            open_, node, found = rows, np.zeros(len(rows), np.int64), []
            for n in range(1, end + 1):
                if n <= 2:
                    byte = data[: len(rows), end - 1].astype(np.int64)
                    to = self.first[byte] if n == 1 else self.second[byte[open_] << 8 | data[open_, end - 2]]
                    on = to >= 0
                    open_, node = open_[on], to[on]
                else:
                    edge = node << 8 | data[open_, end - n]
                    at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                    on = self.edges[at] == edge
                    open_, node = open_[on], self.leads[at[on]].astype(np.int64)
                if not len(open_):
                    break
                token = self.ends[node]
                is_token = token >= 0
                found.append((n, open_[is_token], token[is_token]))
            done = np.zeros(len(rows), bool)
            for n, row, token in reversed(found):  # at most one is valid
                left = ~done[row]
                row, token = row[left], token[left]
                if 1 < n < end:  # where none is valid but the last byte alone, that is, as each prefix has one
                    pair, which = np.unique(last[row, end - n].astype(np.int64) << 20 | token, return_inverse=True)
                    pairs = pair.tolist()
                    known = list(map(self._fits.get, pairs))
                    fit = np.array([self.fits(p >> 20, p & 0xFFFFF) if k is None else k for p, k in zip(pairs, known, strict=True)], bool)[which]
                    row, token = row[fit], token[fit]
                last[row, end] = token
                done[row] = True
            if not done.all():
                raise ValueError(f"no token ends the prefix {pieces[int(done.argmin())][:end]!r}")
        return last

    def short(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of short pieces, longest first, as little-endian unsigned 32-bit integers."""
        last = self.last_tokens(pieces)
        end, row = np.array([len(p) for p in pieces]), np.arange(len(pieces))
        back = []
        while len(row):
            token = last[row, end[row]]
            back.append((row, token))
            end[row] -= self.length[token]
            row = row[end[row] > 0]
        count = np.zeros(len(pieces), np.int64)
        for row, _ in back:
            count[row] += 1
        till = np.cumsum(count)
        ids = np.empty(till[-1], "<u4")
        for k, (row, token) in enumerate(back):
            ids[till[row] - 1 - k] = token
        packed, cuts = ids.tobytes(), [0, *(4 * till).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes spell, read backwards."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def long(self, data: bytes) -> bytes:
        rank = self.ranks.get(data)
        return np.array([rank] if rank is not None else self.walk(self.extend(data, [])), "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of the pieces, from the memo or anew. Of two generations of short pieces the older is forgotten."""
        if len(self._memo) >= MEMO_PIECES:
            self._memo, self._older = {}, self._memo
        memo, older = self._memo, self._older
        new = pieces.difference(memo)  # unlike a difference of key views, this looks the pieces up and doesn't go through the memo
        memo.update({p: older[p] for p in new if p in older})
        names = list(new.difference(older))
        coded = [p.encode() for p in names]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > SHORT_BYTES).sum())
        for i in range(n_long, len(order), 1 << 15):
            block = order[i : i + (1 << 15)].tolist()
            memo.update(zip([names[k] for k in block], self.short([coded[k] for k in block]), strict=True))
        return memo | {names[k]: self.long(coded[k]) for k in order[:n_long].tolist()} if n_long else memo

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            till, chars = at, 0
            while till < len(texts) and (till == at or chars + len(texts[till]) <= BATCH_CHARS):
                chars += len(texts[till])
                till += 1
            if chars > BATCH_CHARS:
                out.append(self._in_runs(texts[at]))
            else:
                lists = [self.pieces.findall(t) for t in texts[at:till]]
                ids = self.learn(set().union(*lists)).__getitem__
                out += [b"".join(map(ids, pieces)) for pieces in lists]
            at = till
        return out

    def _in_runs(self, text: str) -> bytes:
        found, parts = self.pieces.finditer(text), []
        while run := [m.group() for m in islice(found, RUN_PIECES)]:
            parts.append(b"".join(map(self.learn(set(run)).__getitem__, run)))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        """The tokens' bytes, gathered for some thousands of ids at once."""
        ids, parts = np.frombuffer(packed, "<u4"), []
        for i in range(0, len(ids), 1 << 18):
            block = ids[i : i + (1 << 18)]
            n = self.length[block]
            at = np.repeat(self.start[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
            parts.append(self.flat[at].tobytes())
        return b"".join(parts)


class Encoding:
    """An encoded text that can be appended to and edited.

    ``starts`` has each piece's start, ``last`` each piece's last tokens by prefix.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.last: list[list[int]] = []
        self.reused = 0
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]. Pieces are split anew from a little before the edit until the old boundaries are met again."""
        v, old_starts, old_last, old_text = self.vocabulary, self.starts, self.last, self.text
        self.text = old_text[:start] + new + old_text[end:]
        shift = len(self.text) - len(old_text)
        # A piece depends on no text before its start, and on what follows up to the next character that isn't white space.
        keep = max(0, bisect_right(old_starts, start) - 2)
        while keep and not old_text[old_starts[keep] : start].strip():
            keep -= 1
        at = old_starts[keep] if keep < len(old_starts) else 0
        self.starts, self.last, self.reused = old_starts[:keep], old_last[:keep], keep
        after = {s + shift: i for i, s in enumerate(old_starts) if s >= end}
        spare = {old_starts[i]: old_last[i] for i in range(keep, len(old_starts)) if old_starts[i] <= start}
        for m in v.pieces.finditer(self.text, at):
            if m.start() in after and m.start() >= start + len(new):
                i = after[m.start()]
                self.starts += [s + shift for s in old_starts[i:]]
                self.last += old_last[i:]
                self.reused += len(old_starts) - i
                return
            data = m.group().encode()
            have = spare.get(m.start(), [])
            same = len(old_text[m.start() : min(start, m.end())].encode()) if have else 0
            self.starts.append(m.start())
            self.last.append(v.extend(data, have[: min(same, len(have))]))

    def ids(self) -> list[int]:
        return [i for last in self.last for i in self.vocabulary.walk(last)]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def runs(batch: pa.RecordBatch, most: int = 2 * BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes at most, whole rows, so that their pieces fit in memory."""
    per = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, per):
        yield batch.slice(i, per)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of each whole text as little-endian unsigned 32-bit integers, binary; null is encoded as the empty text."""
    from pyspark.sql.types import BinaryType

    @F.arrow_udf(BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for texts in batches:
            yield pa.array(v.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids (as ``encoded`` gives them) stand for."""
    from pyspark.sql.types import BinaryType

    @F.arrow_udf(BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for packed in batches:
            yield pa.array([v.decode(b) if b else b"" for b in packed.to_pylist()], pa.binary())

    return decode(ids)


def encoding_digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty and has no tokens.

    Only the digests leave the task that reads a text. Repeated rows are encoded alike; an empty table gives an
    empty result; other columns aren't read.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for whole in batches:
            for batch in runs(whole):
                packed = v.encode_all([t or "" for t in batch.column(1).to_pylist()])
                n = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([sha(p) for p in packed]), pa.array([sha(v.decode(p)) for p in packed])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Alignment of two tokenizers over the same bytes, by an associative composition of fragments.

Where tokens of both end on one byte, a group ends. A fragment is what a range of bytes shows of the groups: tokens
before its first common end (open, as the group may have begun earlier), the groups closed within it, and tokens after
its last common end (open, as the group may end later). Two neighbouring fragments compose to the fragment of both
ranges: the open tokens between them meet, and close to a group if the right one has a common end. Composition is
associative, so a very long text is cut into byte ranges, each made a fragment in a task of its own, and a tree of
groupings composes them; a text in one range is the product of one.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrack.llm import bpe, pieces
from lumentrack.session import written

#: Texts of more characters are cut; bytes of a range; fragments composed in one step of the tree.
LONG_CHARS, RANGE_BYTES, FAN = 1 << 16, 1 << 16, 8
#: Characters of a batch that are encoded together.
BATCH_CHARS = 1 << 19
#: Bytes of links that are counted or looked up together.
LINK_BYTES = 1 << 23
_NONE = np.zeros(0, np.uint32)
_LONG_PIECE = re.compile(r"\S{2048}|\s{2048}")


class Pair:
    """Both tokenizers: A byte-level, over a space and the text, B in pieces, over the text.

    Whole texts are encoded by the tokenizers' own libraries; parts of texts, which B's can't take, and pieces of A that
    are so long that its library's time grows with their square, by the encoders of this subpackage.
    """

    def __init__(self, ranks: str, pattern: str, model: str):
        self.a, self.b = bpe.vocabulary(ranks, pattern), pieces.loaded(model)
        self.library_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=self.a.ranks, special_tokens={})
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = max(len(self.a.tokens), len(self.b.token))
        if self.size > 1 << 16:
            raise ValueError("links have 16 bits for an id of each side")

    def ids_a(self, text: str) -> bytes:
        return self.a.encode(text) if _LONG_PIECE.search(text) else np.array(self.library_a.encode_ordinary(text), "<u4").tobytes()

    def ids_b(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.library_b.encode(texts, num_threads=1)]

    def most_links(self) -> int:
        """How many different pairs of ids can end on one byte: one's bytes end with the other's. No corpus has more."""
        n_b = Counter(t for t in self.b.data if t)
        shorter_a = sum(t[i:] in self.a.ranks for t in self.b.data for i in range(len(t)))
        return shorter_a + sum(n_b[t[i:]] for t in self.a.ranks for i in range(1, len(t)))


@functools.cache
def spelling(size: int) -> list[str]:
    """What each id is written as, and what follows: another of its kind, or the end of its kind in the group."""
    return [f"{i}{end}" for i in range(size) for end in (",", "|", ";")]


@dataclass
class Fragment:
    """``open_a``, ``open_b`` before the first common end, ``closed`` groups as written with their ``links``, ``rest_a``,
    ``rest_b`` after the last. Without a common end (``cut`` false) all tokens are open before it."""

    cut: bool = False
    open_a: np.ndarray = field(default_factory=lambda: _NONE)
    open_b: np.ndarray = field(default_factory=lambda: _NONE)
    closed: str = ""
    links: np.ndarray = field(default_factory=lambda: _NONE)
    rest_a: np.ndarray = field(default_factory=lambda: _NONE)
    rest_b: np.ndarray = field(default_factory=lambda: _NONE)
    n_a: int = 0
    n_b: int = 0
    same: bool = True  # the tokens' bytes are the text's

    def then(self, other: Fragment) -> Fragment:
        """The fragment of this range and the next one."""
        a, b = np.concatenate([self.rest_a, other.open_a]), np.concatenate([self.rest_b, other.open_b])
        n_a, n_b, same = self.n_a + other.n_a, self.n_b + other.n_b, self.same and other.same
        if not self.cut:
            a, b = np.concatenate([self.open_a, other.open_a]), np.concatenate([self.open_b, other.open_b])
            return Fragment(other.cut, a, b, other.closed, other.links, other.rest_a, other.rest_b, n_a, n_b, same)
        if not other.cut:
            return Fragment(True, self.open_a, self.open_b, self.closed, self.links, a, b, n_a, n_b, same)
        closed, links = group(a, b)
        return Fragment(True, self.open_a, self.open_b, self.closed + closed + other.closed, np.concatenate([self.links, links, other.links]), other.rest_a, other.rest_b, n_a, n_b, same)

    def whole(self) -> tuple[str, np.ndarray]:
        """All groups as written, and all links, of a range that is a whole text."""
        if not self.cut:
            return "", self.links
        first, link = group(self.open_a, self.open_b)
        return (first + self.closed)[:-1], np.concatenate([link, self.links])


def group(a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
    """A group as written, and its link: of all pairs only the last tokens end together."""
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};", _links(a[-1:], b[-1:])


def _links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)


class Groups:
    """The groups of tokens with their ends, of one text or of many set end to end."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b = a, b
        at = np.minimum(np.searchsorted(ends_b, ends_a), max(0, len(ends_b) - 1))
        common = ends_b[at] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
        #: The last token of each group in A and in B.
        self.cut_a, self.cut_b = np.flatnonzero(common), at[common]
        self.links = _links(a[self.cut_a], b[self.cut_b])

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries of ``spelling`` of all closed groups in order, and where each group's end."""
        n_a, n_b = (int(c[-1]) + 1 if len(c) else 0 for c in (self.cut_a, self.cut_b))
        of_a = np.searchsorted(self.cut_a, np.arange(n_a))
        of_b = np.searchsorted(self.cut_b, np.arange(n_b))
        before_b = np.concatenate([[0], self.cut_b[:-1] + 1]) if len(self.cut_b) else np.zeros(0, np.int64)
        out = np.empty(n_a + n_b, np.int64)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.cut_a], last_b[self.cut_b] = 1, 2
        out[np.arange(n_a) + before_b[of_a]] = self.a[:n_a].astype(np.int64) * 3 + last_a
        out[np.arange(n_b) + self.cut_a[of_b] + 1] = self.b[:n_b].astype(np.int64) * 3 + last_b
        return out, self.cut_a + self.cut_b + 2

    def fragment(self, size: int, same: bool = True) -> Fragment:
        n_a, n_b = len(self.a), len(self.b)
        if not len(self.cut_a):
            return Fragment(False, self.a, self.b, n_a=n_a, n_b=n_b, same=same)
        codes, ends = self.codes()
        closed = "".join(map(spelling(size).__getitem__, codes[ends[0] :].tolist()))
        first_a, first_b, last_a, last_b = self.cut_a[0] + 1, self.cut_b[0] + 1, self.cut_a[-1] + 1, self.cut_b[-1] + 1
        return Fragment(True, self.a[:first_a], self.b[:first_b], closed, self.links[1:], self.a[last_a:], self.b[last_b:], n_a, n_b, same)


_pairs: dict[tuple[str, str, str], Pair] = {}


def pair_of(ranks: str, pattern: str, model: str) -> Pair:
    """Loaded once in each Python worker."""
    if (ranks, pattern, model) not in _pairs:
        _pairs[ranks, pattern, model] = Pair(ranks, pattern, model)
    return _pairs[ranks, pattern, model]


def _ids(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the offsets of each text's."""
    return np.frombuffer(b"".join(packed), "<u4"), np.cumsum([0, *(len(p) // 4 for p in packed)])


_ROWS = "doc {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
_NAMES = ["doc", "n_a", "n_b", "n_groups", "groups_sha256", "links"]


def _sha(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _short(pair: Pair, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Each whole text as one range; all at once, as texts end on common ends."""
    packed_a, packed_b = [pair.ids_a(" " + t) if t else b"" for t in texts], pair.ids_b(texts)
    same = np.ones(len(texts), bool)
    wanted = "".join([" " + t if t else "" for t in texts]).encode()
    if pair.a.decode(b"".join(packed_a)) != wanted or pair.b.spelled_bytes(_ids(packed_b)[0]) != wanted:
        for i, t in enumerate(texts):
            data = (" " + t if t else "").encode()
            same[i] = pair.a.decode(packed_a[i]) == data and pair.b.spelled_bytes(np.frombuffer(packed_b[i], "<u4")) == data
        packed_a, packed_b = ([p if s else b"" for p, s in zip(x, same, strict=True)] for x in (packed_a, packed_b))
    (a, at_a), (b, at_b) = _ids(packed_a), _ids(packed_b)
    groups = Groups(a, np.cumsum(pair.a.length[a]), b, np.cumsum(pair.b.length[b]))
    codes, _ = groups.codes()
    text, cuts = spelling(pair.size).__getitem__, (at_a + at_b).tolist()
    written_as = ["".join(map(text, codes[i:j].tolist()))[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]
    n = np.searchsorted(groups.cut_a, at_a)
    links = [groups.links[i:j].tobytes() for i, j in zip(n.tolist(), n[1:].tolist(), strict=False)]
    return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at_a)), pa.array(np.diff(at_b)), pa.array(np.diff(n).astype(np.int64)), pa.array(list(map(_sha, written_as))), pa.array(links, pa.binary())], names=_NAMES)


_FRAGMENT = "doc_row long, range long, cut boolean, open_a binary, open_b binary, closed string, links binary, rest_a binary, rest_b binary, n_a long, n_b long, same boolean"


def _packed(row: int, at: int, f: Fragment) -> list:
    return [row, at, f.cut, f.open_a.tobytes(), f.open_b.tobytes(), f.closed, f.links.tobytes(), f.rest_a.tobytes(), f.rest_b.tobytes(), f.n_a, f.n_b, f.same]


def _unpacked(r) -> Fragment:  # noqa: ANN001
    ids = lambda x: np.frombuffer(x, "<u4")
    return Fragment(bool(r.cut), ids(r.open_a), ids(r.open_b), r.closed, np.frombuffer(r.links, "<u4"), ids(r.rest_a), ids(r.rest_b), int(r.n_a), int(r.n_b), bool(r.same))


#: Before white space that follows none, a piece of A begins whatever stands before; where the space is a plain one and follows no other space sign, B's too.
_BORDER_A = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")


def _places(text: str, every: int, border: regex.Pattern) -> list[int]:
    out, at = [0], every
    while at < len(text) and (m := border.search(text, at)) is not None:
        out.append(m.start())
        at = m.start() + every
    return [*out, len(text)]


def _parts(every: int):  # noqa: ANN202
    """Rows (doc_row, side, start, first, text): the parts of a long text that A and B are run on alone; they differ, as A's borders are more."""
    border_b = regex.compile(rf"(?<=[^ {pieces.SPACE}])(?= )")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for side, whole, border, step in (("a", " " + text, _BORDER_A, every), ("b", text, border_b, every + every // 3)):
                    places, start = _places(whole, step, border), int(side == "b")
                    for i, j in zip(places, places[1:], strict=False):
                        part = whole[i:j]
                        yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([side]), pa.array([start if i else 0]), pa.array([i == 0]), pa.array([part])], names=["doc_row", "side", "start", "first", "text"])
                        start += len(part.encode())

    return run


def _ranges(pair, size: int):  # noqa: ANN001, ANN202
    """Rows (doc_row, range, side, ids, ends, same): the tokens of the parts, dealt to the ranges of bytes that they end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair()
        for batch in batches:
            for r in batch.to_pylist():
                if r["side"] == "a":
                    ids = np.frombuffer(p.ids_a(r["text"]), "<u4")
                    ends, data = p.a.length[ids], p.a.decode(ids.tobytes())
                    wanted = r["text"].encode()
                else:
                    ids = np.frombuffer(p.b.encode(r["text"], r["first"]), "<u4")
                    ends, data = p.b.length[ids], p.b.spelled_bytes(ids)
                    wanted = ((" " if r["first"] else "") + r["text"]).encode()
                ends = r["start"] + np.cumsum(ends)
                of = (ends - 1) // size
                bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                rows = [(r["doc_row"], int(of[i]), r["side"], ids[i:j].tobytes(), ends[i:j].astype("<i8").tobytes(), data == wanted) for i, j in zip(bounds, bounds[1:], strict=False)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(["doc_row", "range", "side", "ids", "ends", "same"], map(list, zip(*rows, strict=True)), strict=True)))

    return run


def _made(size: int):  # noqa: ANN202
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in "ab":
            mine = rows[rows["side"] == side]
            ids, ends = np.frombuffer(b"".join(mine["ids"]), "<u4"), np.frombuffer(b"".join(mine["ends"]), "<i8")
            order = np.argsort(ends, kind="stable")
            sides += [ids[order], ends[order]]
        f = Groups(*sides).fragment(size, bool(rows["same"].all()))
        return pd.DataFrame([_packed(int(key[0]), int(key[1]), f)], columns=[c.split()[0] for c in _FRAGMENT.split(", ")])

    return run


def _product(rows: pd.DataFrame) -> Fragment:
    out = Fragment()
    for r in rows.sort_values("range").itertuples():
        out = out.then(_unpacked(r))
    return out


def _composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_packed(int(key[0]), int(key[1]), _product(rows))], columns=[c.split()[0] for c in _FRAGMENT.split(", ")])


def _finished(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    f = _product(rows)
    if not f.same:
        f = Fragment()
    groups, links = f.whole()
    return pd.DataFrame([[int(key[0]), f.n_a, f.n_b, len(links), _sha(groups), links.tobytes()]], columns=["doc_row", *_NAMES[1:]])


def composed(texts: DataFrame, pair, ids: int, every: int, size: int) -> DataFrame:  # noqa: ANN001
    """The alignment of each row of ``texts`` (doc_row, text), from the fragments of its byte ranges by a tree of groupings."""
    parts = texts.mapInArrow(_parts(every), "doc_row long, side string, start long, first boolean, text string")
    dealt = parts.repartition("doc_row", "side", "start").mapInArrow(_ranges(pair, size), "doc_row long, range long, side string, ids binary, ends binary, same boolean")
    state = dealt.groupBy("doc_row", "range").applyInPandas(_made(ids), _FRAGMENT)
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    ranges = longest // size + 1
    while ranges > FAN:
        state = state.groupBy("doc_row", F.floor(F.col("range") / FAN).alias("range_")).applyInPandas(_composed, _FRAGMENT)
        ranges = -(-ranges // FAN)
    return state.groupBy("doc_row").applyInPandas(_finished, "doc_row long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def aligned(docs: DataFrame, ranks: str, pattern: str, model: str, *, id_col: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row of ``docs``: doc, n_a, n_b, n_groups, groups_sha256, links (of each group in order: A's id in the upper, B's in the lower half of 32 bits)."""
    kind = docs.schema[id_col].dataType.simpleString()
    pair = lambda: pair_of(ranks, pattern, model)
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair()
        for whole in batches:
            for batch in bpe.runs(whole, BATCH_CHARS):
                yield _short(p, batch.column(0), batch.column(1).to_pylist())

    short = rows.filter(F.length("text") <= long_chars).mapInArrow(run, _ROWS.format(kind=kind))
    long = written(rows.filter(F.length("text") > long_chars).withColumn("doc_row", F.monotonically_increasing_id()))
    if long.isEmpty():
        return short
    found = composed(long.select("doc_row", "text"), pair, pair().size, long_chars, range_bytes)
    return short.unionByName(long.select("doc_row", "doc").join(found, "doc_row").drop("doc_row"))


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, n): how many links of the corpus are of each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bpe.runs(whole, LINK_BYTES)):
            links, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(links.astype(np.int64)), pa.array(n.astype(np.int64))], names=["link", "n"])

    return rows.select("links").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def alignment_digests(docs: DataFrame, ranks: str, pattern: str, model: str, **options) -> DataFrame:  # noqa: ANN003
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that the tokens' bytes don't give back, have no tokens: zeros and an empty string.
    Repeated rows are aligned alike and count again; an empty table gives an empty result; other columns aren't read.
    Tokens of the two end together only if the bytes of one end with the other's, so the table of counts is bounded by
    the vocabularies (``Pair.most_links``): it is gathered, checked against that bound and broadcast.
    """
    rows = written(aligned(docs, ranks, pattern, model, **options))
    counts = link_counts(rows).toPandas().sort_values("link")
    most = pair_of(ranks, pattern, model).most_links()
    if len(counts) > most:
        raise RuntimeError(f"{len(counts)} pairs of ids end together, where the vocabularies allow {most}")
    link, n = counts["link"].to_numpy(np.int64).astype(np.uint32), counts["n"].to_numpy(np.int64)
    best = n == counts.groupby(counts["link"] & 0xFFFF)["n"].transform("max").to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((link, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bpe.runs(whole, LINK_BYTES)):
            known, n, best = shared.value
            packed = batch.column("links").to_pylist()
            at = np.cumsum([0, *(len(p) // 4 for p in packed)])
            place = np.searchsorted(known, np.frombuffer(b"".join(packed), "<u4"))
            sums = [np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[at] for x in (best, n)]
            columns = [batch.column("doc"), batch.column("n_a"), batch.column("n_b"), batch.column("n_groups"), pa.array(np.diff(at)), *(pa.array(np.diff(s)) for s in sums), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[options.get("id_col", "doc_id")].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

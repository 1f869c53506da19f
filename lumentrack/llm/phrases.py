"""Phrases of words that keep company, from a weighted graph of overlapping word groups.

Only longest groups (three words) are counted: they are edges from their first two words to their last two. Where a
piece ends, or a longer group is surely too rare for a phrase, a shorter group is counted in its stead, as what ends
in its node. So each occurrence of a word is counted in one group that starts with it, and the counts of all shorter
groups follow: what flows out of a node, and what ends there. Chains of nodes with one way in and one way out are
compacted to paths: their inner nodes occur only within longer groups, as often as these.

That a group is too rare is read off a table of hashed slots whose size follows the text's: first all groups are
counted by slot, then a group is counted by its words only if its slot reached the floor. A slot holds at least what
any of its groups has, so none that reaches the floor is missed and counts are exact, however full the slots are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumentrack.llm.bpe import runs
from lumentrack.llm.texts import flat
from lumentrack.session import written

#: Words in the longest group, and how often a phrase occurs at least.
MOST_WORDS, FLOOR = 3, 10
#: Bytes of text that are worked on at once; a longer piece is taken whole.
BLOCK = 1 << 21
#: Bits of the table of frequent slots that tasks hold: 16 MB whatever the input.
TABLE_BITS = 27
#: Bits of a slot's number within its part. Text of so many characters fills one part; at least so many parts; groups
#: gathered in a task before it hands them on.
SLOT_BITS, PART_CHARS, LEAST_PARTS, GATHER = 28, 1 << 27, 256, 1 << 21
#: Share of a phrase's occurrences, in hundredths, that lie in one longer phrase and make it superfluous.
WITHIN = 50

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 for blanks between words, 2 for ends of pieces `[.,;:!?\x0A-\x0D]`.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SIGN = np.random.default_rng(12).integers(1, 1 << 63, (2, 256)).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(lane: int, n: int) -> np.ndarray:
    out = np.full(n, _ODD[lane], np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """The words of a block of lower-cased bytes, the texts they are in, and hashes of the groups that start with each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, salts: np.ndarray):
        """``ends``: where each text ends; ``salts``: a number for each text, alike for texts counted together."""
        kind = _KIND[data]
        word = kind == 0
        starts, stops = word.copy(), word.copy()
        starts[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        border = ends[(ends > 0) & (ends < len(data))]
        starts[border] = word[border]
        stops[border - 1] = word[border - 1]
        self.data, self.start, self.stop = data, np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(ends, self.start, "right")
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.start) + self.text
        n = len(self.start)
        #: Words of the same piece from each on, three at most.
        self.room = np.ones(n, np.int8)
        for k in range(1, MOST_WORDS):
            self.room[:-k] += piece[k:] == piece[:-k]
        self._bytes = data[word].astype(np.int64)
        self._size = self.stop - self.start
        self._salt = salts[self.text]

    def hashes(self, lane: int = 0) -> list[np.ndarray]:
        """For k = 1 to 3: a 64-bit hash of the k words from each on; without meaning where a piece has fewer."""
        n = len(self.start)
        if not n:
            return [np.zeros(0, np.uint64)] * MOST_WORDS
        at = np.cumsum(self._size) - self._size
        place = np.arange(len(self._bytes)) - np.repeat(at, self._size)
        sums = np.add.reduceat(_SIGN[lane][self._bytes] * _powers(lane, int(self._size.max()))[place], at)
        one = _mixed(sums ^ self._size.astype(np.uint64))
        group, out = _mixed(one + self._salt), []
        out.append(group)
        for k in range(1, MOST_WORDS):
            longer = group.copy()
            longer[:-k] = _mixed(group[:-k] * _ODD[1] + one[k:])
            out.append(longer)
            group = longer
        return out

    def spelled(self, i: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + k].tolist(), self.stop[i : i + k].tolist(), strict=True)).decode()


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """The words of a batch (text, lang) block by block, cut at ends of pieces, and the texts' languages."""
    for part in runs(batch, BLOCK):
        langs = ["und" if x is None else x for x in part.column(1).to_pylist()]
        of = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}
        salts = np.array([of[x] for x in langs], np.uint64)
        data, offsets = flat(part.column(0))
        data, ends = _LOWER[data], offsets[1:]
        if len(data) <= 2 * BLOCK:
            cuts = [0, len(data)]
        else:
            places = np.union1d(np.flatnonzero(_KIND[data] == 2) + 1, offsets)
            cuts = [0]
            while cuts[-1] < len(data):
                k = int(np.searchsorted(places, cuts[-1] + BLOCK, "right")) - 1
                cuts.append(int(places[k] if places[k] > cuts[-1] else places[k + 1]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield Words(data[a:b], ends - a, salts), langs


def _steps(slots: np.ndarray) -> bytes:
    """Rising numbers as steps, all their low bytes first: the high ones are nearly all zero, which compresses."""
    return np.diff(slots, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _slots(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _counted_slots(texts: DataFrame, parts: int) -> DataFrame:
    """(part, once, often, counts): slots of groups as each task met them, once, or more often with counts up to 255."""
    shift, gather = np.uint64(64 - int(math.log2(parts))), max(GATHER, 64 * parts)

    def handed(found: list[np.ndarray]) -> pa.RecordBatch:
        slot, count = np.unique(np.concatenate(found), return_counts=True)
        of = (slot >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(of, np.arange(parts + 1))
        low, once, count = slot.astype(np.uint32), count == 1, np.minimum(count, 255).astype(np.uint8)
        rows = [(p, _steps(low[a:b][once[a:b]]), _steps(low[a:b][~once[a:b]]), count[a:b][~once[a:b]].tobytes()) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "once", "often", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for words, _ in _blocks(batch):
                for k, h in enumerate(words.hashes()):
                    h = h[words.room > k]
                    # The part in the upper half, its slot in the lower.
                    found.append((h >> shift) << np.uint64(32) | (h & np.uint64((1 << SLOT_BITS) - 1)))
                    size += len(h)
                if size >= gather:
                    yield handed(found)
                    found, size = [], 0
        if size:
            yield handed(found)

    return texts.mapInArrow(run, "part int, once binary, often binary, counts binary")


def frequent_slots(texts: DataFrame, floor: int = FLOOR, parts: int | None = None) -> tuple[np.ndarray, int]:
    """A table of bits, one for each range of slots, that are set where a slot reached ``floor``, and the number of parts.

    Each part of the slots is counted in a task of its own; the table that is gathered has TABLE_BITS bits at all sizes.
    """
    if parts is None:
        chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        parts = max(LEAST_PARTS, 1 << math.ceil(math.log2(max(1, chars / PART_CHARS))))
    per = max(3, TABLE_BITS - int(math.log2(parts)))

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, often = (np.concatenate([_slots(b) for b in rows[c]]) for c in ("once", "often"))
        slot, inverse = np.unique(np.concatenate([once, often]), return_inverse=True)
        count = np.bincount(inverse[: len(once)], minlength=len(slot)) + np.bincount(inverse[len(once) :], np.frombuffer(b"".join(rows["counts"]), np.uint8), minlength=len(slot)).astype(np.int64)
        bits = np.zeros(1 << per, np.uint8)
        bits[slot[count >= floor] >> np.uint32(SLOT_BITS - per)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((parts, (1 << per) // 8), np.uint8)
    for part, bits in _counted_slots(texts, parts).groupBy("part").applyInPandas(merged, "part int, bits binary").toLocalIterator():
        table[part] = np.frombuffer(bits, np.uint8)
    return table, parts


def longest_groups(texts: DataFrame, table: Broadcast, parts: int) -> DataFrame:
    """(lang, phrase, words, n): every word's occurrences, each counted once in the longest group from there on whose slot is frequent.

    Words in no such group are left out, but for their number: ``words`` = 0 has that of all words of a language.
    """
    shift = np.uint64(64 - int(math.log2(parts)))
    per = max(3, TABLE_BITS - int(math.log2(parts)))

    def passes(h: np.ndarray) -> np.ndarray:
        place = (h & np.uint64((1 << SLOT_BITS) - 1)) >> np.uint64(SLOT_BITS - per)
        byte = table.value[(h >> shift).astype(np.int64), (place >> np.uint64(3)).astype(np.int64)]
        return (byte >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, langs in _blocks(batch):
                first, second = words.hashes(), words.hashes(1)
                level = np.zeros(len(words.start), np.int8)
                key, check = np.zeros(len(level), np.uint64), np.zeros(len(level), np.uint64)
                for k in range(MOST_WORDS):
                    on = np.flatnonzero(words.room > k)
                    on = on[passes(first[k][on])]
                    level[on], key[on], check[on] = k + 1, first[k][on], second[k][on]
                used = np.flatnonzero(level)
                _, at, which, count = np.unique(key[used], return_index=True, return_inverse=True, return_counts=True)
                sample = used[at]
                # Groups are told apart by both hashes; one that shares only the first is listed by itself.
                odd = used[(check[used] != check[sample[which]]) | (level[used] != level[sample[which]])]
                for i in odd:
                    count[which[np.searchsorted(used, i)]] -= 1
                sample, count = np.concatenate([sample, odd]), np.concatenate([count, np.ones(len(odd), np.int64)])
                text, n = np.unique(words.text, return_counts=True)
                of = [langs[t] for t in words.text[sample].tolist()] + [langs[t] for t in text.tolist()]
                phrases = [words.spelled(i, k) for i, k in zip(sample.tolist(), level[sample].tolist(), strict=True)] + [""] * len(text)
                sizes, counts = np.concatenate([level[sample], np.zeros(len(text), np.int8)]), np.concatenate([count, n])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "words", "n"])

    found = texts.mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _first(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def _rest(phrase: str) -> Column:
    return F.expr(f"substring({phrase}, locate(' ', {phrase}) + 1)")


def counts_by_flow(groups: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(lang, phrase, words, f): groups of 1 to 3 words with at least ``floor`` occurrences.

    A node's count is what flows out of it by longer groups and what ends in it.
    """
    out = []
    for k in range(1, MOST_WORDS + 1):
        flow = groups.filter(f"words >= {k}").groupBy("lang", _first("phrase", k).alias("phrase")).agg(F.sum("n").alias("f"))
        out.append(flow.filter(F.col("f") >= floor).select("lang", "phrase", F.lit(k).alias("words"), "f"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def unary_paths(counts: DataFrame) -> DataFrame:
    """(lang, head, at, edge, f): the edges of the graph by path, ``head`` the path's first edge and ``at`` an edge's place, from 0.

    Two edges follow on each other in a path if the node between them has no other edge and neither begins nor ends
    a piece: then its count, that of the edge into it and that of the edge out of it are equal. No such nodes form a
    ring, as pieces that begin somewhere would have to enter it. Places are found by doubling: each round, an edge
    takes over where the edge that it points at points; so there are as many rounds as the length of the longest
    piece has binary digits.
    """
    edges = counts.filter("words = 3").select("lang", F.col("phrase").alias("edge"), "f")
    into = edges.select("lang", _rest("edge").alias("node"), F.col("edge").alias("before"), F.col("f").alias("f_in"))
    node = counts.filter("words = 2").select("lang", F.col("phrase").alias("node"), F.col("f").alias("f_node"))
    from_ = edges.withColumn("node", _first("edge", 2))
    # An edge into a node that is as frequent as the node leaves nothing for another one.
    whole = into.join(node, ["lang", "node"]).filter("f_in = f_node").select("lang", "node", "before", "f_node")
    linked = from_.join(whole, ["lang", "node"], "left").withColumn("up", F.when(F.col("f") == F.col("f_node"), F.col("before")))
    state = written(linked.select("lang", "edge", "f", F.coalesce("up", "edge").alias("head"), F.col("up").isNotNull().cast("long").alias("at")))
    while True:
        above = state.filter("at > 0").select("lang", F.col("edge").alias("head"), F.col("head").alias("further"), F.col("at").alias("more"))
        if above.join(state.filter("at > 0").select("lang", "head").distinct(), ["lang", "head"], "semi").isEmpty():
            return state
        moved = state.join(above, ["lang", "head"], "left")
        state = written(moved.select("lang", "edge", "f", F.coalesce("further", "head").alias("head"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))


def path_phrases(paths: DataFrame) -> DataFrame:
    """(lang, phrase, words, f): each path in one row, all its words in order. A path is no longer than a piece."""
    last = F.substring_index("edge", " ", -1)
    rows = paths.groupBy("lang", "head").agg(F.expr("array_join(transform(array_sort(collect_list(struct(at, edge))), x -> substring_index(x.edge, ' ', -1)), ' ')").alias("tail"), F.min("f").alias("f"), F.count(last).alias("edges"))
    return rows.select("lang", F.concat_ws(" ", _first("head", 2), "tail").alias("phrase"), (F.col("edges") + 2).alias("words"), "f")


def scored(counts: DataFrame, totals: DataFrame, paths: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 and 3 words that no longer one makes superfluous.

    A phrase is cut where its score is least, after the fewest words of equals.
    """
    edge_ends = paths.select("lang", F.explode(F.array(_first("edge", 2), _rest("edge"))).alias("phrase"), "f")
    # An inner node of a path lies within an edge as often as it occurs: this needs no count.
    inner = paths.filter("at > 0").select("lang", _first("edge", 2).alias("phrase"))
    longest = edge_ends.groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))
    two = counts.filter("words = 2").join(inner, ["lang", "phrase"], "anti").join(longest, ["lang", "phrase"], "left")
    two = two.filter(F.col("f_longer").isNull() | (100 * F.col("f_longer") < WITHIN * F.col("f"))).select("lang", "phrase", "words", "f")
    kept = two.unionByName(counts.filter("words = 3"))
    parts = kept.select("lang", "phrase", "f", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    parts = parts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    known = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    parts = parts.join(known, ["lang", "left"]).join(known.withColumnsRenamed({"left": "right", "l": "r"}), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    parts = parts.withColumn("top", (big("f") * big("f")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("low", big("l") * big("r"))
    parts = parts.withColumn("score", F.expr("cast(top div low as bigint)"))
    best = parts.groupBy("lang", "phrase").agg(F.min_by(F.struct("f", "l", "r", "score"), F.struct("score", "k")).alias("b"))
    return best.select("lang", "phrase", F.col("b.f").alias("a"), "b.l", "b.r", "b.score").join(totals, "lang")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", floor: int = FLOOR, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language, by score, frequency, phrase.

    Texts are lower-cased (A to Z) and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, these into words `[^\\x20\\x09]+`. Null
    text counts as empty, null lang as `und`. Repeated rows count again; other columns aren't read; an empty table, and
    languages without a phrase that occurs ``floor`` times, give no rows. Very long texts are worked on block by block.
    """
    texts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table, parts = frequent_slots(texts, floor)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    groups = written(longest_groups(texts, shared, parts))
    totals = groups.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = written(counts_by_flow(groups, floor))
    found = scored(counts, totals, unary_paths(counts))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Of a language dealt to 64 windows first, each hands on its best.
    dealt = found.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

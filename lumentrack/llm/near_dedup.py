"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Equal texts are collapsed. What follows sees one document for each text.
2. The document frequency of every shingle common enough to matter is counted over all distinct texts.
3. Each document is sketched: sample k is the shingle (and its level) that consistent weighted sampling number k
   picks, so that two documents agree in a sample with the probability of their weighted Jaccard similarity.
4. Documents that agree in a band of samples meet, and are candidates if enough of all samples agree.
5. Candidates are verified by the weighted Jaccard similarity of their whole texts. Classes are the components of
   the verified links. In a bucket too large for all its members to meet, each meets one of them at first. Then pairs
   of different components meet that share a shingle without which they can't be similar enough: for some turns those
   outside of a shingle's largest component meet some members of it, at last all do. So no pair is left out, and what
   is joined before needs no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrack.functions.components import connected_components
from lumentrack.functions.slots import marked, slots
from lumentrack.llm.quality_pu import word_hashes
from lumentrack.llm.texts import flat, word_bounds
from lumentrack.session import fresh, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: 1 - (1 - 0.8^4)^16: two documents at the threshold miss each other with probability 0.0002.
BANDS, BAND_ROWS = 16, 4
#: A shingle in fewer than one of so many documents has the full weight; commoner ones weigh less. So the table of
#: common shingles has at most IDF_CEILING x (mean shingles of a document) rows, however many documents there are.
IDF_CEILING = 16
#: All members of a bucket of at most so many meet each other. See ``later_meetings`` for larger ones.
SMALL_BUCKET = 24
#: In each turn so many members of a shingle's largest component meet what is outside of it; after these turns all do.
PARTNERS = (8, 128)
#: Shingles are ordered by counts in a table of 2^ORDER_BITS slots. Where shingles are many more than slots the order
#: says less of their rarity, and more pairs are tested, but any order that all texts share leaves no pair out.
ORDER_BITS = 20
#: Of the 64 samples so many agree in a candidate pair: five standard deviations below the mean of a pair at the threshold.
LEAST_AGREE = 35
_STEP = 0.02
_HASH_BITS = 44
_BLOCK = 1 << 15

# --- shingles and weights ---


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """44-bit hashes of each text's runs of SHINGLE_WORDS words, and the n + 1 offsets. A text of fewer words is one run; one without words has none."""
    data, at = flat(texts)
    starts, ends, words = word_bounds(data, at)
    h, n = word_hashes(data, starts, ends), np.diff(words)
    left = np.repeat(words[1:], n) - np.arange(len(h))  # words to the text's end
    total = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE_WORDS):
            following = np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, following, np.uint64(k))
            total ^= total >> np.uint64(31)
    kept = (left >= SHINGLE_WORDS) | (np.repeat(n, n) < SHINGLE_WORDS) & (left == np.repeat(n, n))
    return total[kept] >> np.uint64(64 - _HASH_BITS), np.concatenate([[0], np.cumsum(kept)])[words]


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, how often it has each, and the offsets."""
    s, at = shingles(texts)
    n = len(at) - 1
    key = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(_HASH_BITS)) | s)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, count = key[first], np.diff(np.append(first, len(key)))
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(_HASH_BITS))
    return key & np.uint64((1 << _HASH_BITS) - 1), count, bounds


class Weights:
    """Weight of a shingle: its count x ln(1 + documents / documents with it), the ratio held at IDF_CEILING."""

    def __init__(self, n_docs: int, common: list[tuple[int, int]]):
        common = sorted(common)
        self.keys = np.array([h for h, _ in common], np.uint64)
        ratio = n_docs / np.maximum(np.array([d for _, d in common], float), 1)
        self.idf = np.log1p(np.minimum(ratio, IDF_CEILING))
        self.rare = float(np.log1p(IDF_CEILING))

    def of(self, s: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(len(s), self.rare)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            hit = self.keys[i] == s
            idf[hit] = self.idf[i[hit]]
        return count * idf

    def levels(self, s: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weights on a logarithmic scale of steps of 2 %, which sampling takes; verification takes them as they are."""
        return np.round(np.log(self.of(s, count)) / _STEP).astype(np.int32)


def common_shingles(texts: DataFrame) -> list[tuple[int, int]]:
    """Each shingle that at least one in IDF_CEILING of all texts has, with their number, of a one-column table.

    One pass keeps, in each task, the shingles that more than a fraction of its texts have (counts that fell below it
    are dropped, and what may so be lost is kept as slack). Those that can reach the threshold over all tasks, at
    most twice IDF_CEILING x the mean number of shingles, are counted exactly by a second pass.
    """
    part = 4 * IDF_CEILING

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, slack, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in _pieces(batches):
            new, n = np.unique(counted(batch.column(0))[0], return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            old = where[: len(counts)]
            c, d = np.zeros(len(keys), np.int64), np.full(len(keys), seen // part)
            np.add.at(c, where, np.concatenate([counts, n]))
            d[old] = slack
            seen += batch.num_rows
            kept = (c + d) * part >= seen
            keys, counts, slack = keys[kept], c[kept], d[kept]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts + slack), pa.array(np.full(len(keys), seen))], names=["h", "n", "seen"])

    n_docs = texts.count()
    most = F.sum("n") + (n_docs - F.sum("seen")) / part
    found = texts.mapInArrow(local, "h long, n long, seen long").groupBy("h").agg(most.alias("most")).filter(F.col("most") * IDF_CEILING >= n_docs)
    candidates = np.sort(np.array([r["h"] for r in found.select("h").collect()], np.uint64))
    if not len(candidates):
        return []
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in _pieces(batches):
            s = counted(batch.column(0))[0]
            i = np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)
            total += np.bincount(i[shared.value[i] == s], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.astype(np.int64)), pa.array(total)], names=["h", "n"])

    sums = texts.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * IDF_CEILING >= n_docs)
    return [(r["h"], r["n"]) for r in sums.collect()]


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes at most, whole rows."""
    for whole in batches:
        per = max(1, int(whole.num_rows * most / max(1, whole.nbytes)))
        for i in range(0, whole.num_rows, per):
            yield whole.slice(i, per)


# --- sketches ---


class Sampler:
    """Improved consistent weighted sampling. Its random numbers come, by a hash of shingle and sample, from tables of 2^16 draws."""

    def __init__(self, samples: int = BANDS * BAND_ROWS):
        rng = np.random.default_rng(20)
        n = 1 << 16
        self.r, self.log_c = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n)
        self.factors = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.gains: dict[int, np.ndarray] = {}

    def steps(self, level: np.ndarray | int, i: np.ndarray | slice) -> np.ndarray:
        return np.floor(level * _STEP / self.r[i] + self.beta[i])

    def gain(self, level: np.ndarray | int, i: np.ndarray | slice) -> np.ndarray:
        """ln of y e^r: what is taken off ln c to give ln a."""
        return (self.r[i] * (self.steps(level, i) - self.beta[i] + 1)).astype(np.float32)

    def sketches(self, s: np.ndarray, levels: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of 32-bit samples for each document; documents without shingles get zeros."""
        out = np.zeros((len(at) - 1, len(self.factors)), np.uint32)
        full = np.flatnonzero(np.diff(at))
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + _BLOCK)))
            rows, a, b = full[i:j], at[full[i]], at[full[j - 1] + 1]
            out[rows] = self._block(s[a:b], levels[a:b], at[rows] - a)
            i = j
        return out

    def _block(self, s: np.ndarray, levels: np.ndarray, starts: np.ndarray) -> np.ndarray:
        values, counts = np.unique(levels, return_counts=True)
        main = int(values[counts.argmax()])
        if main not in self.gains:
            self.gains[main] = self.gain(main, slice(None))
        table, other = self.gains[main], np.flatnonzero(levels != main)
        place = np.arange(len(s), dtype=np.uint64)
        out = np.empty((len(starts), len(self.factors)), np.uint32)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(self.factors):
                z = s * factor
                z ^= z >> np.uint64(32)
                z *= np.uint64(0xD6E8FEB86659FD93)
                first, second = (z >> np.uint64(48)).astype(np.int32), ((z >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
                log_a = self.log_c.take(second) - table.take(first)
                if len(other):
                    log_a[other] = self.log_c[second[other]] - self.gain(levels[other], first[other])
                # Positive floats order as their bits do, so the place rides along below them.
                key = (np.maximum(log_a + np.float32(96), np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | place
                best = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                t = self.steps(levels[best], first[best]).astype(np.int64).astype(np.uint64)
                mixed = (s[best] + t * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                out[:, k] = mixed >> np.uint64(32)
        return out


_samplers: list[Sampler] = []


def sketched(rows: DataFrame, weights: Callable[[], Weights]) -> DataFrame:
    """(rid, sketch) of each row (rid, text) that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _samplers:
            _samplers.append(Sampler())
        w = weights()
        for batch in _pieces(batches):
            s, n, at = counted(batch.column(1))
            sketch = _samplers[0].sketches(s, w.levels(s, n), at)
            has = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.array([sketch[i].tobytes() for i in has], pa.binary())], names=["rid", "sketch"])

    return rows.mapInArrow(run, "rid binary, sketch binary")


@F.arrow_udf(T.IntegerType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """In how many samples two sketches agree."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


# --- candidates ---


def banded(sketches: DataFrame) -> DataFrame:
    """(key, rid): a row for each band of each document."""
    width = 4 * BAND_ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * width + 1, width)) for b in range(BANDS)])
    return sketches.select(F.explode(keys).alias("key"), "rid")


def _sized(bands: DataFrame) -> DataFrame:
    """``bands`` within buckets of two or more, with the bucket's size and its first member.

    Joined on the key and a hash of it, so that both sides are exchanged for the join alone and hot keys can be split.
    """
    buckets = bands.groupBy(F.col("key").alias("key2")).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low")).filter("n > 1")
    return bands.join(buckets, (F.col("key") == F.col("key2")) & (F.hash("key") == F.hash("key2"))).drop("key2")


def _all_pairs(bands: DataFrame) -> DataFrame:
    """Pairs within small buckets (key, rid, n): each member meets less than SMALL_BUCKET others in each."""
    small = bands.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select(F.col("key").alias("k"), F.col("rid").alias("b"))
    return small.select("key", F.col("rid").alias("a")).join(other, (F.col("key") == F.col("k")) & (F.col("a") < F.col("b"))).select("a", "b")


def first_meetings(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of documents that share a band, and the members (key, rid) of buckets too large to pair all of them.

    In small buckets all members meet, in large ones each meets the first.
    """
    sized = written(_sized(bands))
    star = sized.filter((F.col("n") > SMALL_BUCKET) & (F.col("rid") > F.col("low"))).select(F.col("low").alias("a"), F.col("rid").alias("b"))
    return star.unionByName(_all_pairs(sized)).distinct(), written(sized.filter(F.col("n") > SMALL_BUCKET).select("key", "rid"))


def _in_components(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the component ``c`` of each rid; one without a link is its own."""
    return rows.join(named.select("node", "component"), F.col("rid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rid")).drop("node", "component")


def parted(large: DataFrame, named: DataFrame) -> DataFrame:
    """The members (rid) of large buckets that hold several components."""
    members = _in_components(large, named)
    several = members.groupBy(F.col("key").alias("key2")).agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("key2")
    return members.join(several, (F.col("key") == F.col("key2")) & (F.hash("key") == F.hash("key2"))).select("rid").distinct()


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles, one for each text (rid, text) that has it, fall into each of 2^ORDER_BITS slots by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in _pieces(batches):
            total += np.bincount(_slots(counted(batch.column(1))[0]), minlength=len(total))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    sums = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return out


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(_HASH_BITS - ORDER_BITS)).astype(np.int64)


def prefixes(texts: DataFrame, weights: Callable[[], Weights], similarity: float) -> DataFrame:
    """(h, rid, whole, rest): the shingles of each text (rid, text) that similar texts must share one of.

    Shingles are ordered by the count of their slot, least first, then by their hash: one order for all texts, in which
    rare shingles come early. One that is alone in its slot has no other text and is left out. ``rest`` is the weight
    of the text's other shingles from this one on, ``whole`` that of all its shingles. Two texts of weights x and y that
    are similar enough have s (x + y) / (1 + s) in common, s x or more, and all of it from the first shingle on that
    they share. So in both texts that shingle has as much rest.
    """
    least = similarity - 1e-6
    shared = texts.sparkSession.sparkContext.broadcast(slot_counts(texts))  # of 2^ORDER_BITS slots, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        for batch in _pieces(batches):
            s, n, at = counted(batch.column(1))
            weight, row = w.of(s, n), np.repeat(np.arange(batch.num_rows), np.diff(at))
            whole, count = np.bincount(row, weight, batch.num_rows), shared.value[_slots(s)]
            order = np.lexsort((s, -count, row))  # the last shingle first, for sums from there
            order = order[count[order] > 1]
            s, row, weight = s[order], row[order], weight[order]
            before = np.concatenate([[0.0], np.cumsum(weight)])
            rest = before[1:] - before[np.searchsorted(row, row)]
            kept = np.flatnonzero(rest >= least * whole[row])
            rid = batch.column(0).take(pa.array(row[kept]))
            yield pa.RecordBatch.from_arrays([pa.array(s[kept].astype(np.int64)), rid, pa.array(whole[row[kept]]), pa.array(rest[kept])], names=["h", "rid", "whole", "rest"])

    return written(texts.select("rid", "text").mapInArrow(run, "h long, rid binary, whole double, rest double"))


def later_meetings(marks: DataFrame, named: DataFrame, similarity: float, partners: int | None, turn: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough by their ``prefixes``.

    Within a shingle what is outside of its largest component meets up to ``partners`` members of that, others in each
    turn; without a number, it meets all the others.
    """
    least = similarity - 1e-6
    marks = _in_components(marks, named)
    parts = marks.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"))
    tops = parts.groupBy(F.col("h").alias("h2")).agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    mixed = written(marks.join(tops, (F.col("h") == F.col("h2")) & (F.hash("h") == F.hash("h2"))).drop("h2").withColumn("inside", F.col("c") == F.col("top")).drop("top"))
    side = lambda df, x: df.select(F.col("h").alias(f"h{x}"), F.col("rid").alias(x), F.col("whole").alias(f"w{x}"), F.col("rest").alias(f"rest{x}"), F.col("c").alias(f"c{x}"), F.col("inside").alias(f"inside{x}"))
    others = mixed
    if partners is not None:
        chance = F.xxhash64("rid", F.lit(turn))
        held = mixed.filter("inside").withColumn("chance", chance).groupBy("h", F.pmod("chance", F.lit(partners)).alias("slot"))
        others = held.agg(F.min_by(F.struct("rid", "whole", "rest", "c", "inside"), "chance").alias("one")).select("h", "one.*")
    both = F.col("wa") + F.col("wb")
    common = least / (1 + least) * both
    fits = (F.col("ha") == F.col("hb")) & (F.col("ca") != F.col("cb")) & (F.least("resta", "restb") >= common) & (F.least("wa", "wb") >= least / (1 + least) * both)
    # Of two outside of the largest component, the smaller is the one that meets.
    met = side(mixed.filter("not inside"), "a").join(side(others, "b"), fits & (F.col("insideb") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose rid has no slot of ``keys`` (r); a few more than those with a key are left."""
    return marked(rows, slots(keys, "r"), "rid", "_may").filter("_may").drop("_may")


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in enough samples. Sketches that aren't in a pair don't move."""
    pairs = written(pairs)
    sketches = _among(sketches, pairs.select(F.explode(F.array("a", "b")).alias("r")))
    a, b = (sketches.select(F.col("rid").alias(f"r{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("ra")).join(b, F.col("b") == F.col("rb"))
    return both.filter(agreement("sa", "sb") >= LEAST_AGREE).drop("ra", "rb", "sa", "sb")


# --- verification ---


def jaccard(a: pa.Array, b: pa.Array, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(a)
    sides = []
    for texts in (a, b):
        s, count, at = counted(texts)
        pair = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
        sides.append(((pair << np.uint64(_HASH_BITS)) | s, weights.of(s, count), pair.astype(np.int64)))
    (ka, wa, pa_), (kb, wb, pb) = sides
    total = np.bincount(pa_, wa, n) + np.bincount(pb, wb, n)
    if not len(kb):
        return np.zeros(n)
    i = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[i] == ka
    common = np.bincount(pa_[hit], np.minimum(wa[hit], wb[i[hit]]), n)
    return common / np.maximum(total - common, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, weights: Callable[[], Weights], similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    Pairs and the texts in them are written first, so that their sizes are known. Hardly a text that isn't in a pair
    moves.
    """
    pairs = written(pairs.select("a", "b"))
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct())
    texts = written(_among(texts, ends).join(ends, F.col("rid") == F.col("r"), "left_semi").select("rid", "text"))
    ta, tb = (texts.select(F.col("rid").alias(f"r{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.select("a", "b").join(ta, F.col("a") == F.col("ra")).join(tb, F.col("b") == F.col("rb")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        for batch in _pieces(batches):
            near = np.flatnonzero(jaccard(batch.column(2), batch.column(3), w) >= similarity - 1e-9)
            yield batch.select(["a", "b"]).take(pa.array(near))

    return both.mapInArrow(run, "a binary, b binary")


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    class_id is the largest doc_id of the class; that row is kept. Equal texts (null counts as empty) are of one
    class; texts without words are near no other text. Rows that repeat id and text share their verdict. Null ids
    are ignored when the class is named. An empty table gives an empty result; other columns aren't read.
    """
    return _judged(docs, id_col, text, similarity).drop("rid")


def _judged(docs: DataFrame, id_col: str, text: str, similarity: float) -> DataFrame:
    """``near_classes`` with the key of each row's text, rid."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text)).alias("rid"), body.alias("text"))
    rows = written(source.select("doc_id", "rid"))
    equal = written(rows.groupBy("rid").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")))

    # From here on there is one document for each text, so that copies don't make a text's shingles common.
    # Texts without a copy are read from ``docs`` each time they are needed: only the others, and few more, move and are written.
    several = _among(rows, equal.filter("n > 1").select(F.col("rid").alias("r")))
    split = marked(source, slots(several, "doc_id"), "doc_id", "_may")
    copies = written(split.filter("_may").select("rid", "text").dropDuplicates(["rid"]))
    distinct = split.filter("not _may").select("rid", "text").unionByName(copies)
    common = common_shingles(distinct.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast((equal.count(), common))  # bounded by IDF_CEILING x mean shingles
    made: list[Weights] = []

    def weights() -> Weights:
        if not made:
            made.append(Weights(*shared.value))
        return made[0]

    sketches = written(sketched(distinct, weights))
    pairs, large = first_meetings(banded(sketches))
    candidates = written(alike(pairs, sketches))
    ends = written(candidates.select(F.explode(F.array("a", "b")).alias("r")).union(large.select("rid")).distinct())
    texts = written(_among(distinct, ends).join(ends, F.col("rid") == F.col("r"), "left_semi"))

    named = connected_components(written(verified(candidates, texts, weights, similarity)), "a", "b")
    left = written(parted(large, named))
    if not left.isEmpty():
        members = written(texts.join(left.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left_semi").repartition("rid"))
        marks = prefixes(members, weights, similarity)
        for turn, partners in enumerate((*PARTNERS, None)):
            more = written(verified(later_meetings(marks, named, similarity, partners, turn), texts, weights, similarity))
            if not more.isEmpty():
                named = _joined(named, more)

    classes = equal.join(named, F.col("rid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rid"))
    whole = classes.groupBy(F.col("component").alias("c")).agg(F.max("top").alias("class_id"), F.sum("n").alias("class_size")).filter("class_size > 1")
    of_text = written(classes.join(whole, (F.col("component") == F.col("c")) & (F.hash("component") == F.hash("c"))).select(F.col("rid").alias("r"), "class_id", "class_size"))
    out = rows.join(of_text, F.col("rid") == F.col("r"), "left")
    class_id = F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "rid", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (node, component) with the components that further links (a, b) join."""
    both = links
    for end in ("a", "b"):
        of = named.select(F.col("node").alias("n"), F.col("component").alias("c"))
        both = both.join(of, F.col(end) == F.col("n"), "left").withColumn(f"c{end}", F.coalesce("c", end)).drop("n", "c")
    both = written(both)
    merged = connected_components(both, "ca", "cb")
    new = both.select(F.col("a").alias("node"), F.col("ca").alias("component")).union(both.select("b", "cb")).distinct()
    everyone = named.union(new.join(named, "node", "left_anti"))
    up = merged.select(F.col("node").alias("n"), F.col("component").alias("to"))
    return written(everyone.join(up, F.col("component") == F.col("n"), "left").select("node", F.coalesce("to", "component").alias("component")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all its columns, less the rows that aren't the kept ones of their classes.

    Rows that repeat both id and text all stay if one does. What goes is named by id and text key, so other texts of the
    same id, or without one, stay; rows whose id isn't in the slot of one that goes stay where they are.
    """
    key, may = fresh(docs.columns, "_key"), fresh(docs.columns, "_may")
    dropped = _judged(docs, id_col, text, similarity).filter("not kept")
    dropped = written(dropped.select(F.col("doc_id").alias("_drop_id"), F.col("rid").alias("_drop_rid")).distinct())
    split = marked(docs, slots(dropped, "_drop_id"), id_col, may)
    rows = split.filter(may).drop(may).withColumn(key, text_key(F.col(text)))
    gone = rows[id_col].eqNullSafe(dropped["_drop_id"]) & (rows[key] == dropped["_drop_rid"])
    return split.filter(~F.col(may)).drop(may).union(rows.join(dropped, gone, "left_anti").drop(key))

"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, exactly as a uniform shuffle of all rows would
have it. Each partition then deals its rows out at random to these counts, the rows are exchanged, and each shard
is put in random order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrack.session import cut, fresh

#: The driver deals to so many groups of neighbouring partitions at most; each task deals its own group's rows on.
GROUPS = 1024
#: A shard is put in order in buckets of about so many rows.
BUCKET_ROWS = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good, from the masses within twelve standard deviations of the mean: what lies beyond is below the last bit of their sum."""
    total = good + bad
    mean = n * good / total
    spread = 12 * np.sqrt(mean * bad / total * (total - n) / max(1, total - 1)) + 10
    k = np.arange(max(0, n - bad, int(mean - spread)), min(good, n, int(mean + spread)) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (n - k[:-1]) / (k[1:] * (bad - n + k[1:])))
    log_mass = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(log_mass - log_mass.max()))
    return int(k[min(np.searchsorted(mass, rng.random() * mass[-1], "right"), len(k) - 1)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows of partition p that go to shard j, with row sums ``counts`` and column sums ``sizes``."""
    rng, left = np.random.default_rng(seed), [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest, need = sum(left), int(n)
        for j in range(len(left)):
            rest -= left[j]
            out[p, j] = x = hypergeometric(rng, left[j], rest, need) if need else 0
            need -= x
            left[j] -= x
    return out


@dataclass
class Deal:
    """The matrix as a tree: rows of the groups of partitions are drawn at once, those of one group's partitions where they are needed."""

    counts: np.ndarray
    sizes: list[int]
    seed: int
    per_group: int

    def __post_init__(self):
        starts = range(0, len(self.counts), self.per_group)
        self.group_rows = communication_matrix([int(self.counts[i : i + self.per_group].sum()) for i in starts], self.sizes, [self.seed, 0, 3])
        self.drawn: tuple[int, np.ndarray] | None = None

    def row(self, p: int) -> np.ndarray:
        """How many rows of partition p go to each shard; the same on every call, in every process."""
        g = p // self.per_group
        if self.drawn is None or self.drawn[0] != g:
            members = self.counts[g * self.per_group : (g + 1) * self.per_group]
            self.drawn = g, communication_matrix(members.tolist(), self.group_rows[g].tolist(), [self.seed, g, 2])
        return self.drawn[1][p - g * self.per_group]


def dealt(seed: int, p: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition p's shard for each of its rows in turn, and a random key for each: the same on every call."""
    rng = np.random.default_rng([seed, p, 1])
    shards = np.repeat(np.arange(len(row), dtype=np.int32), row)
    rng.shuffle(shards)
    return shards, rng.integers(0, 2**63, len(shards))


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, *, seed: int = 1, stable: bool = False, bucket_rows: int = BUCKET_ROWS, groups: int = GROUPS) -> DataFrame:
    """All columns of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes are at most one apart. Columns of ``df`` that are named shard or slot give way to the new ones.
    ``stable`` says that reading ``df`` again gives each partition the same rows in the same order, as a scan of
    files does; otherwise it is written to the checkpoint folder first. Nulls and repeated rows are rows as any
    other; an empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    df = df if stable else cut(df)
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    total = sum(counts)
    deal = Deal(np.array(counts, np.int64), [total // n_shards + (j < total % n_shards) for j in range(n_shards)], seed, max(1, -(-len(counts) // groups)))
    shared = df.sparkSession.sparkContext.broadcast(deal)  # a count for each partition and a row for each group
    key, part, at = (fresh(df.columns, c) for c in ("_key", "_part", "_at"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, done = TaskContext.get().partitionId(), 0
        known = p < len(shared.value.counts)
        shards, keys = dealt(seed, p, shared.value.row(p)) if known else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for batch in batches:
            till = done + batch.num_rows
            if till > len(shards):
                raise ValueError(f"partition {p} has more rows than when it was counted; pass stable=False")
            new = [pa.array(shards[done:till]), pa.array(keys[done:till]), pa.array(np.full(batch.num_rows, p)), pa.array(np.arange(done, till))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "shard", key, part, at])
            done = till
        if done != len(shards):
            raise ValueError(f"partition {p} has fewer rows than when it was counted; pass stable=False")

    more = [T.StructField("shard", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in (key, part, at)]
    rows = df.mapInArrow(label, T.StructType([*df.schema.fields, *more]))
    n_buckets = max(1, -(-total // n_shards // bucket_rows))
    bucket = fresh(df.columns, "_bucket")
    rows = rows.withColumn(bucket, F.least(F.floor(F.col(key) / float(2**63) * n_buckets), F.lit(n_buckets - 1)).cast("int"))
    within = Window.partitionBy("shard", bucket).orderBy(key, part, at)
    rows = rows.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    if n_buckets > 1:
        spark = df.sparkSession

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    shards, keys = dealt(seed, p, shared.value.row(p))
                    b = np.minimum(np.floor(keys / float(2**63) * n_buckets), n_buckets - 1).astype(np.int64)
                    n = np.bincount(shards * np.int64(n_buckets) + b)
                    cell = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array((cell // n_buckets).astype(np.int32)), pa.array((cell % n_buckets).astype(np.int32)), pa.array(n[cell])], names=["shard", bucket, "n"])

        # The draws are repeated to count the buckets; the rows themselves aren't read for it.
        drawn = spark.range(len(counts)).repartition(min(len(counts), 64)).mapInArrow(sizes, f"shard int, `{bucket}` int, n long")
        filled = drawn.groupBy("shard", bucket).agg(F.sum("n").alias("n"))
        before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        start = fresh(df.columns, "_start")
        offsets = filled.select("shard", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
        rows = rows.join(offsets, ["shard", bucket]).withColumn("slot", F.col("slot") + F.col(start)).drop(start)
    return rows.select(*df.columns, "shard", "slot")


def shard_digests(docs: DataFrame, n_shards: int = 16, *, seed: int = 1, stable: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; null has none), text_crc32, law, shard, slot, grown_shard, of the whole documents as they are shuffled."""
    out = shuffle_into_shards(docs, n_shards, seed=seed, stable=stable)
    body = F.coalesce(F.col(text), F.lit(""))
    size, crc = (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32")
    return out.select(F.col(id_col).alias("doc_id"), size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int = 16, *, seed: int = 1) -> None:
    """The shuffled rows as Parquet, a folder for each shard, each file in slot order."""
    out = shuffle_into_shards(df, n_shards, seed=seed)
    block = F.floor(F.col("slot") / 1_000_000)
    out.repartition("shard", block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

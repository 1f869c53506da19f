"""Ranks over whole tables, without a task over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.session import cut, fresh


def global_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in ``order``: sorted by ranges, each range counted from where the one before it ends."""
    p, i = fresh(df.columns, "_p"), fresh(df.columns, "_i")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, order).sortWithinPartitions(order)
    ordered = cut(ordered.withColumn(p, F.spark_partition_id()).withColumn(i, F.monotonically_increasing_id().bitwiseAND(2**33 - 1)))
    before = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each of at most n partitions.
    starts = ordered.groupBy(p).count().select(F.col(p), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return ordered.join(F.broadcast(starts), p).withColumn(name, F.col(i) + F.col("_start")).drop(p, i, "_start")

"""Measuring only what is new, as a stream: each micro-batch stores the rows whose keys the store lacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumentrack.sources.sinks import only_new


def store_only_new(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, measure: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """SK-13: appends ``measure`` of the new rows of each batch to the Parquet store at ``path``; of rows with one key in a batch one is stored.

    A batch that is replayed finds its keys stored, so nothing is stored twice.
    """
    spark, schema = stream.sparkSession, None

    def add(batch: DataFrame, _: int) -> None:
        nonlocal schema
        rows = batch.dropDuplicates(list(keys))
        measured = measure(rows)
        schema = measured.schema
        measured.limit(0).write.mode("append").parquet(path)  # the store exists from the first batch on
        only_new(measured, spark.read.schema(schema).parquet(path), keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

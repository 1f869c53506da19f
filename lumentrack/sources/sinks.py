"""Sinks: the flat measurement table, selections, incremental stores, extracted datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.functions.ranking import global_rank


def measurement_table(objects: DataFrame, ancestors: Sequence[tuple[DataFrame, int, str]] = (), columns: Sequence[str] = ()) -> DataFrame:
    """SK-1, JO-12: base columns, own columns, and those of ancestor classes joined by truncated paths (null where there is none).

    ``objects`` has position, indices (array) and ``columns``; each ancestor is (table with position, indices and its
    columns, its depth in indices, a prefix).
    """
    out = objects.select("position", F.array_join(F.col("indices").cast("array<string>"), "-").alias("Indices"), F.get("indices", F.lit(0)).alias("Frame"), F.element_at("indices", -1).alias("Idx"), *columns, F.col("indices").alias("_i"))
    for table, depth, prefix in ancestors:
        own = [c for c in table.columns if c not in ("position", "indices")]
        up = table.select(F.col("position").alias("_p"), F.col("indices").alias("_up"), *[F.col(c).alias(f"{prefix}{c}") for c in own])
        out = out.join(up, (F.col("position") == F.col("_p")) & (F.slice("_i", 1, depth) == F.col("_up")), "left").drop("_p", "_up")
    return out.drop("_i")


def write_table(table: DataFrame, path: str, by_position: bool = False, order: Sequence[str] = ("position", "Indices")) -> None:
    """SK-1, SK-4: CSV with ';' and NA, sorted; one folder a position if asked for, each sorted by itself."""
    rows = table.repartition("position").sortWithinPartitions(*order) if by_position else table.orderBy(*order)
    writer = rows.write.option("sep", ";").option("header", "true").option("nullValue", "NA")
    (writer.partitionBy("position") if by_position else writer).csv(path)


def selection_table(selections: DataFrame) -> DataFrame:
    """SK-3: selections as rows, with the frame (the path's first part)."""
    return selections.select(F.col("position").alias("Position"), F.col("oc").alias("ObjectClassIdx"), F.col("indices").alias("Indices"), F.split_part("indices", F.lit("-"), F.lit(1)).cast("int").alias("Frame"), F.col("name").alias("SelectionName"))


def only_new(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SK-13: rows whose key isn't stored yet."""
    return incoming.join(stored.select(*keys), list(keys), "left_anti")


def upserted(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SK-13: the store with the incoming rows in place of those with the same keys."""
    return stored.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def subsampled(df: DataFrame, step: int, offset: int, frame: str = "frame") -> DataFrame:
    """SK-6, SK-9: every ``step``-th frame from ``offset`` on."""
    return df.filter(F.pmod(F.col(frame) - offset, F.lit(step)) == 0)


def previous_links(df: DataFrame, *, track: str = "track", frame: str = "frame", label: str = "id", by: Sequence[str] = ("n",)) -> DataFrame:
    """SK-12: (label, previous label, frames left out between them)."""
    w = Window.partitionBy(track).orderBy(*by)
    return df.select(F.col(label).alias("label"), F.lag(label).over(w).alias("previous"), (F.col(frame) - F.lag(frame).over(w) - 1).alias("gap")).filter("previous is not null")


def pixel_table(regions: DataFrame, channels: DataFrame, keys: Sequence[str], n_channels: int) -> DataFrame:
    """SK-11: a row per pixel of each object with a column per channel, at places relative to the object's centre."""
    rows = regions.join(channels, ["frame", "y", "x"]).groupBy(*keys, "y", "x").pivot("channel", list(range(n_channels))).agg(F.first("value"))
    whole = Window.partitionBy(*keys)
    return rows.withColumns({"dy": F.col("y") - F.avg("y").over(whole), "dx": F.col("x") - F.avg("x").over(whole)})


def json_lines(df: DataFrame) -> DataFrame:
    """SK-15: each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def track_rows(df: DataFrame, track: Column) -> DataFrame:
    """SK-9: (label, begin, end) of each track, labels counted from 1 in order of the track."""
    spans = df.groupBy(track.alias("track")).agg(F.min("frame").alias("begin"), F.max("frame").alias("end"))
    return global_rank(spans, F.col("track").asc(), "label").withColumn("label", F.col("label") + 1)

"""Composite chains: functions from table to table, put together. Everything stays lazy but the loops within components and links."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.operators import linking, measures, pixels
from lumentrack.operators.spatial import container, mask_overlap

Step = Callable[[DataFrame], DataFrame]


def preprocessed(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """PL-1: transformations in order. A step that needs the whole table first computes it as an aggregate of its own input."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def segmented(df: DataFrame, foreground: Column, keys: Sequence[str] = ("frame",), pre: Sequence[Step] = (), post: Sequence[Step] = (), low: bool = False) -> tuple[DataFrame, DataFrame]:
    """PL-2, TH-10: (pixels of objects, objects with their measures)."""
    mask = preprocessed(df, pre).filter(foreground)
    regions = preprocessed(pixels.components(mask, keys, low), post)
    own = [*keys, "object_id"]
    values = regions.join(df, [*keys, "y", "x"])
    objects = measures.measured(measures.geometry(regions, own), own, measures.centres(values, own), measures.intensity(values, own))
    return regions, objects


def tracked(objects: DataFrame, gate: float, max_gap: int = 1) -> DataFrame:
    """PL-3: links (src, dst, cost) between objects (frame, object_id, x, y), whose ids are frame x 2^32 + object_id."""
    points = objects.select(F.shiftleft(F.col("frame").cast("long"), 32).bitwiseOR(F.col("object_id").cast("long")).alias("id"), "frame", "x", "y")
    return linking.mutual_best(linking.candidates(points, gate, max_gap=max_gap))


def duplicated(regions: DataFrame, parents: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """PL-4: a class's pixels again as another class, each object with its most overlapping parent, trimmed to that parent's pixels."""
    best = container(mask_overlap(regions, parents, keys), keys).select(*keys, F.col("a").alias("object_id"), F.col("b").alias("parent_id"))
    inside = parents.select(*keys, "y", "x", F.col("object_id").alias("parent_id"))
    return regions.join(best, [*keys, "object_id"]).join(inside, [*keys, "y", "x", "parent_id"], "left_semi")


def all_measured(objects: DataFrame, keys: Sequence[str], features: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """PL-5, ME-33: each feature function gives a table by key; all side by side."""
    return measures.measured(objects.select(*keys).distinct(), keys, *[f(objects) for f in features])

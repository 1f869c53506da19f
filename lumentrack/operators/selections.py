"""Set algebra over selections: tables (name, oc, position, indices) of objects, and object tables filtered by them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.functions.ranking import global_rank

KEY = ["position", "indices"]


def union(*selections: DataFrame) -> DataFrame:
    """SE-1."""
    out = selections[0].select(*KEY)
    for s in selections[1:]:
        out = out.union(s.select(*KEY))
    return out.distinct()


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """SE-2."""
    out = first.select(*KEY)
    for s in others:
        out = out.intersect(s.select(*KEY))
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SE-3: distinct members of a that b lacks."""
    return a.select(*KEY).distinct().join(b.select(*KEY), KEY, "left_anti")


def same_class(selections: DataFrame, oc: int) -> DataFrame:
    """Selections of another class than ``oc`` take no part in set operations."""
    return selections.filter(F.col("oc") == oc)


def within(objects: DataFrame, selection: DataFrame, level: str = "self", depth: int = 1) -> DataFrame:
    """SK-2, JO-11: objects in a selection of their own class, of an ancestor class or of a descendant class.

    ``depth`` is the number of levels between the classes.
    """
    picked = selection.select(F.col("position").alias("_p"), F.col("indices").alias("_i"))
    own = F.array_join(F.col("indices").cast("array<string>"), "-")
    if level == "ancestor":
        own = F.array_join(F.slice(F.col("indices"), F.lit(1), F.size("indices") - depth).cast("array<string>"), "-")
    elif level == "descendant":
        picked = picked.withColumn("_i", F.array_join(F.slice(F.split("_i", "-"), F.lit(1), F.size(F.split("_i", "-")) - depth), "-")).distinct()
    return objects.join(picked, (F.col("position") == F.col("_p")) & (own == F.col("_i")), "left_semi")


def parents(selection: DataFrame, levels: int = 1) -> DataFrame:
    """SE-11: distinct ancestors, ``levels`` above."""
    parts = F.split("indices", "-")
    return selection.select("position", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - levels), "-").alias("indices")).distinct()


def without_children_of(selection: DataFrame, parents_: DataFrame) -> DataFrame:
    """SE-12: members less those below ``parents_``, one level up."""
    parts = F.split("indices", "-")
    up = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "-")
    gone = parents_.select(F.col("position").alias("_p"), F.col("indices").alias("_i"))
    return selection.join(gone, (F.col("position") == F.col("_p")) & (up == F.col("_i")), "left_anti")


def with_child(parents_: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SE-8: objects that have a child in the tested classes."""
    return parents_.join(children.select(*keys).distinct(), list(keys), "left_semi")


def with_any_child(parents_: DataFrame, classes: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """SE-8: objects that have a child in at least one of the tested classes; none tested, none stays."""
    found = [c.select(*keys) for c in classes] or [parents_.select(*keys).limit(0)]
    for c in found[1:]:
        found[0] = found[0].union(c)
    return with_child(parents_, found[0], keys)


def frames(selection: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """SE-15: members within frames, both ends included."""
    f = F.split_part("indices", F.lit("-"), F.lit(1)).cast("int")
    out = selection
    if first is not None:
        out = out.filter(f >= first)
    return out if last is None else out.filter(f <= last)


def neighbours(positions: DataFrame) -> DataFrame:
    """SE-11: each position with the one before and after it in order of name, by global rank."""
    ranked = global_rank(positions.select("position").distinct(), F.col("position"), "_k")
    beside = lambda by, name: ranked.select((F.col("_k") + by).alias("_k"), F.col("position").alias(name))
    return ranked.join(beside(1, "previous"), "_k", "left").join(beside(-1, "next"), "_k", "left").select("position", "previous", "next")


def predicate(tree: dict[str, Any]) -> Column:
    """SE-14: a tree of tests as one column.

    {'all': [...]}, {'any': [...]}, or a leaf: {'column', 'over' or 'under', 'strict'} on numbers (NaN passes, absent
    or not a number fails), {'column', 'is': True/False} on flags (the strings true and false count), {'column',
    'equals'} on text. An empty 'all' holds, an empty 'any' doesn't.
    """
    if "all" in tree or "any" in tree:
        out = F.lit("all" in tree)
        for sub in tree.get("all", tree.get("any")):
            out = out & predicate(sub) if "all" in tree else out | predicate(sub)
        return out
    c = F.col(tree["column"])
    if "is" in tree:
        return F.coalesce(F.lower(c.cast("string")) == str(tree["is"]).lower(), F.lit(False))
    if "equals" in tree:
        return F.coalesce(c.cast("string") == tree["equals"], F.lit(False))
    v, strict = F.expr(f"try_cast(`{tree['column']}` AS double)"), tree.get("strict", True)
    if "over" in tree:
        test = v > tree["over"] if strict else v >= tree["over"]
    else:
        test = v < tree["under"] if strict else v <= tree["under"]
    return F.coalesce(F.isnan(v) | test, F.lit(False))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SK-14: rows of one store that the other lacks, counted with repeats, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))

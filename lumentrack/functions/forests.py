"""Maximum spanning forests of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrack.session import written


def _roots(up: DataFrame) -> DataFrame:
    """(c, root) from (c, to), where the only rings are pairs that point at each other; the smaller of a pair is a root."""
    back = up.select(F.col("c").alias("to"), F.col("to").alias("_back"))
    state = written(up.join(back, "to").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
    while True:
        further = state.select(F.col("c").alias("to"), F.col("to").alias("_to"))
        moved = state.join(further, "to").select("c", F.col("_to").alias("new"), (F.col("_to") != F.col("to")).alias("moved"))
        moved = written(moved)
        state = moved.select("c", F.col("new").alias("to"))
        if moved.filter("moved").isEmpty():
            return state.select("c", F.col("to").alias("root"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight): of the undirected ``edges`` (a, b, weight) a forest of greatest total weight that joins whatever they join.

    Each round every component takes its heaviest edge (the greatest ends of equals, so no ring arises) and is joined
    with what that leads to; of parallel edges between components the heaviest stays. Components at least halve in a
    round. Loops, and edges with a null, are left out.
    """
    key = F.struct(F.col("weight").alias("w"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = edges.filter("a <> b and weight is not null").select(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"), key.alias("e"))
    left = written(left.groupBy("ca", "cb").agg(F.max("e").alias("e")))
    parts = [left.limit(0).select("e")]
    while not left.isEmpty():
        ends = left.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "e").union(left.select("cb", "ca", "e"))
        best = written(ends.groupBy("c").agg(F.max(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e"))
        parts.append(best.select("e").distinct())
        root = _roots(best.select("c", "to"))
        for end in ("ca", "cb"):
            left = left.join(root.select(F.col("c").alias(end), F.col("root").alias(f"_{end}")), end).drop(end)
        left = left.filter("_ca <> _cb").groupBy(F.least("_ca", "_cb").alias("ca"), F.greatest("_ca", "_cb").alias("cb")).agg(F.max("e").alias("e"))
        left = written(left)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("e.a", "e.b", F.col("e.w").alias("weight"))

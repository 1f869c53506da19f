"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrack.session import written


def _renamed(edges: DataFrame, up: DataFrame) -> DataFrame:
    """Both ends of each edge replaced by what they hang on; loops and repeats dropped, the smaller end first."""
    for end in ("a", "b"):
        moved = up.select(F.col("b").alias("_of"), F.col("to").alias("_to"))
        edges = edges.join(moved, F.col(end) == F.col("_of"), "left").withColumn(end, F.coalesce("_to", end)).drop("_of", "_to")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; a component is named by its smallest node.

    Each round hangs every node that has a smaller neighbour on the smallest one, shortens the hanging paths to
    their roots by doubling, and keeps only the edges between roots. Rounds end when none is left; the number of
    nodes with edges falls at least by half in each. What nodes hang on is put together from the last round back, so each
    round's table is joined once and what is moved in all grows as the first round's does. Null ends are ignored; loops make
    their node a component.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    loops = ends.filter("a = b").select(F.col("a").alias("node")).distinct()
    left = written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))  # repeats go with the first round
    rounds = []
    while not left.isEmpty():
        up = written(left.groupBy("b").agg(F.min("a").alias("to")))
        while True:
            further = up.select(F.col("b").alias("_of"), F.col("to").alias("_to"))
            up = written(up.join(further, F.col("to") == F.col("_of"), "left").select("b", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
            moving = not up.filter("moved").isEmpty()
            up = up.select("b", "to")
            if not moving:
                break
        rounds.append(up)
        left = written(_renamed(left, up))
    if not rounds:
        return loops.withColumn("component", F.col("node"))
    labels = None
    for up in reversed(rounds):
        if labels is not None:
            later = labels.select(F.col("node").alias("_of"), F.col("component").alias("_to"))
            moved = up.join(later, F.col("to") == F.col("_of"), "left").select("b", F.coalesce("_to", "to").alias("to"))
            # Roots of this round that hang on others later on.
            up = moved.unionByName(labels.select(F.col("node").alias("b"), F.col("component").alias("to")))
        labels = written(up.select(F.col("b").alias("node"), F.col("to").alias("component")))
    own = labels.select(F.col("component").alias("node")).union(loops.join(labels.select("node"), "node", "left_anti")).distinct()
    return labels.unionByName(own.withColumn("component", F.col("node")))

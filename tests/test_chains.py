"""Chains and the incremental store, end to end on a few frames."""

from pyspark.sql import functions as F

from lumentrack.plans import chains
from lumentrack.streaming.incremental import store_only_new


def frames(spark):
    """A 2 x 2 square that moves right by one in each frame, and a single bright pixel that stays."""
    rows = [(f, y, x, 5.0 if (f + 1 <= x <= f + 2 and 1 <= y <= 2) or (x, y) == (8, 8) else 0.0) for f in range(3) for y in range(10) for x in range(10)]
    return spark.createDataFrame(rows, "frame int, y int, x int, value double")


def test_segment_then_track(spark):
    regions, objects = chains.segmented(frames(spark), F.col("value") > 1)
    sizes = sorted((r.frame, r.pixels) for r in objects.collect())
    assert sizes == [(0, 1), (0, 4), (1, 1), (1, 4), (2, 1), (2, 4)]
    links = chains.tracked(objects, 3.0).collect()
    assert len(links) == 4 and sorted(r.cost for r in links) == [0.0, 0.0, 1.0, 1.0]
    again = chains.duplicated(regions, regions)
    assert again.count() == regions.count() and again.filter("object_id <> parent_id").count() == 0


def test_only_new_rows_are_stored(spark, tmp_path):
    incoming = str(tmp_path / "in")
    schema = "k int, v string"
    for batch in ([(1, "a"), (2, "b"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        store_only_new(stream, str(tmp_path / "store"), ["k"], str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "store")).collect()
    assert sorted((r.k, r.v) for r in rows) == [(1, "a"), (2, "b"), (3, "d")]

"""Findings of round 3: rows without a size, results of joins by place on crowded planes, work that grows with the input alone."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lumentrack.operators import pixels as P
from lumentrack.operators import spatial as J
from lumentrack.operators import tracks as T
from lumentrack.plans import catalogue


def test_windowed_slope_leaves_out_rows_without_a_value(spark):
    sizes = [1.0, 2.0, 0.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0]
    rows = spark.createDataFrame([(1, n, float(n), s) for n, s in enumerate(sizes)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0), (2, 2, 2.0, 5.0)], "track long, n long, hours double, size double")
    for log in (F.log("size"), F.when(F.col("size") > 0, F.log("size")).otherwise(float("-inf"))):
        got = {(r.track, r.n): r.slope for r in T.windowed_slope(rows.withColumn("log_size", log), 3).collect()}
        assert [got[1, n] for n in range(9)] == pytest.approx([math.log(2)] * 9)
        assert [got[2, n] for n in range(3)] == [None] * 3


def no_pairs(*_, **__):
    raise AssertionError("the table of all pairs is built")


def test_close_points_of_crowds_are_settled_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "close_pairs", no_pairs)
    rng = random.Random(3)
    places = [(rng.choice([rng.gauss(0, 1.5), rng.uniform(-40, 40)]), rng.uniform(-40, 40)) for _ in range(240)]
    rows = [(i, i % 2, *places[i % 240], float(rng.randrange(6))) for i in range(300)] + [(900, 0, None, 1.0, 1.0), (901, 0, float("nan"), 0.0, 1.0), (902, 0, 0.0, 0.0, None)]
    points = spark.createDataFrame(rows, "id long, frame int, x double, y double, quality double")
    far = lambda p, q: p[1] != q[1] or p[2] is None or q[2] is None or not (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 < 9.0
    stay = []
    for p in sorted(rows, key=lambda p: (p[4] is None, -(p[4] or 0), p[0])):
        if all(far(p, q) for q in stay):
            stay.append(p)
    assert sorted(r.id for r in J.without_close(points, 3.0, ["frame"]).collect()) == sorted(p[0] for p in stay)
    alone = [p[0] for p in rows if all(far(p, q) for q in rows if q[0] != p[0])]
    assert sorted(r.id for r in J.without_close(points, 3.0, ["frame"], both=True).collect()) == sorted(alone)


def test_boxes_are_matched_without_the_table_of_pairs(spark, monkeypatch):
    rng = random.Random(5)
    box = lambda i: (i % 2, f"k{rng.randrange(10**6)}-{i}", (x := rng.randrange(-9, 30)), x + rng.randrange(7), (y := rng.randrange(-9, 20)), y + rng.randrange(5))
    a, b = (spark.createDataFrame([box(i) for i in range(400)], "frame int, key string, xmin int, xmax int, ymin int, ymax int") for _ in range(2))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    pairs = J.box_pairs(a, b)
    assert rows(J.best_boxes(a, b, cell=2)) == rows(J.container(pairs))
    assert rows(J.best_boxes_both_ways(a, b, cell=2)) == rows(J.best_both_ways(pairs))
    totals = lambda df: df.groupBy("frame", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap"), F.max("overlap"), F.max("size_a"))
    columns = ["frame", "a", "n", "overlap_sum", "overlap_max", "size_a"]
    assert rows(J.box_totals(a, b, cell=2).select(columns)) == rows(totals(pairs))
    assert rows(J.box_totals(a, b, where=lambda o, p, q: o > 0.5 * q).select(columns)) == rows(totals(pairs.filter("overlap > 0.5 * size_b")))
    monkeypatch.setattr(J, "box_pairs", no_pairs)
    for name in ("jo_05_container", "jo_08_max_overlap", "me_10_inclusion_counts", "me_17_overlap_area", "me_25_seg_metrics"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_nearest_pixels_are_dealt_without_a_join(spark):
    rows = [(0, y, x, float(10 * y + x)) for y in range(7) for x in range(5) if (y, x) != (3, 3)] + [(1, 0, 0, 1.0), (1, 9, 0, 2.0), (1, 0, -1, 3.0), (None, 0, 0, 4.0)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, value double")
    at = {r[:3]: r[3] for r in rows}
    for w, h in ((5, 7), (3, 20), (11, 2), (1, 1)):
        got = P.resampled(df, 5, 7, w, h)
        want = [(f, y, x, at[f, s, t]) for f in (0, 1) for y in range(h) for x in range(w) if (s := int((y + 0.5) * 7 / h), t := int((x + 0.5) * 5 / w)) and (f, s, t) in at]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan

"""Deletion and merging of objects with their links, unions of objects, interpolation, background at the border: hand-made cases."""

import math

from lumentrack.operators import editing as G
from lumentrack.operators import pixels as P
from lumentrack.operators import populations as A
from lumentrack.operators import selections as S


def objects(spark):
    rows = [(1, "p", 0), (2, "p", 1), (3, "p", 2), (4, "q", 0), (5, "q", 1), (6, "r", 0)]
    return spark.createDataFrame(rows, "id int, parent string, idx int")


def linked(spark):
    """1 divides into 4 and 5, which merge in 6; 2 goes on to nothing."""
    return spark.createDataFrame([(1, 4, "previous"), (1, 5, "previous"), (4, 6, "next"), (5, 6, "next")], "src int, dst int, kind string")


def ids(spark, *members):
    return spark.createDataFrame([(m,) for m in members], "id int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_deletion_counts_siblings_anew(spark):
    assert rows(G.without_objects(objects(spark), ids(spark, 2, 2, 4, 99)).select("id", "parent", "idx")) == [(1, "p", 0), (3, "p", 1), (5, "q", 0), (6, "r", 0)]
    assert rows(G.without_objects(objects(spark), ids(spark, 2).filter("false")).select("id", "idx")) == rows(objects(spark).select("id", "idx"))


def test_deletion_of_a_daughter_joins_the_tracks_if_asked(spark):
    assert rows(G.without_links_of(linked(spark), ids(spark, 4))) == [(1, 5, "both"), (5, 6, "both")]
    assert rows(G.without_links_of(linked(spark), ids(spark, 4), merge_tracks=False)) == [(1, 5, "previous"), (5, 6, "next")]
    assert rows(G.without_links_of(linked(spark), ids(spark, 6))) == [(1, 4, "previous"), (1, 5, "previous")]


def test_merging_daughters_makes_one_track(spark):
    groups = spark.createDataFrame([(5, "g"), (4, "g"), (1, "alone"), (2, "apart"), (6, "apart")], "id int, group string")
    assert rows(G.merge_names(objects(spark), groups)) == [(1, 1), (2, 2), (4, 4), (5, 4), (6, 6)]
    assert rows(G.merged_objects(objects(spark), groups).select("id", "idx")) == [(1, 0), (2, 1), (3, 2), (4, 0), (6, 0)]
    assert rows(G.merged_links(linked(spark), objects(spark), groups)) == [(1, 4, "both"), (4, 6, "both")]


def test_merging_objects_with_several_before_and_after(spark):
    links = spark.createDataFrame([(1, 4, "both"), (2, 5, "both"), (4, 6, "both"), (5, 7, "both"), (4, 5, "both")], "src int, dst int, kind string")
    groups = spark.createDataFrame([(4, "g"), (5, "g")], "id int, group string")
    assert rows(G.merged_links(links, objects(spark), groups)) == [(1, 4, "next"), (2, 4, "next"), (4, 6, "previous"), (4, 7, "previous")]


def mask(spark, cells):
    return spark.createDataFrame([(0, o, y, x) for o, y, x in cells], "frame int, object_id int, y int, x int")


def test_union_joins_through_the_other_class(spark):
    a, b = mask(spark, [(3, 0, 0), (5, 0, 2), (8, 5, 5)]), mask(spark, [(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 9, 9)])
    assert rows(A.united(a, b)) == [(0, 0, 3, 0, 0), (0, 0, 3, 0, 1), (0, 0, 3, 0, 2), (0, 0, 8, 5, 5), (0, 1, 2, 9, 9)]
    assert rows(A.united(a, b.filter("false"))) == [(0, 0, 3, 0, 0), (0, 0, 5, 0, 2), (0, 0, 8, 5, 5)]
    assert rows(A.intersection(a, b).select("frame", "object_id", "y", "x")) == [(0, 3, 0, 0), (0, 5, 0, 2)]


def test_parent_by_overlap_only_where_none_is_named(spark):
    parents, children = mask(spark, [(1, 0, 0), (1, 0, 1), (2, 0, 2)]), mask(spark, [(7, 0, 1), (7, 0, 2), (8, 0, 2), (9, 4, 4)])
    own = spark.createDataFrame([(0, 8, 1)], "frame int, object_id int, parent int")
    assert {(r.object_id, r.parent) for r in A.parents_or_overlapping(parents, children, own).collect()} == {(7, 1), (8, 1), (9, None)}


def image(spark, cells):
    return spark.createDataFrame([(0, y, x, float(v)) for (x, y), v in cells.items()], "frame int, y int, x int, value double")


def test_quarter_turns_fall_on_pixels(spark):
    cells = {(x, y): 10 * y + x for x in range(4) for y in range(4)}
    turned = {(r.x, r.y): r.value for r in P.rotated(image(spark, cells), 4, 4, 90).collect()}
    assert turned == {(3 - y, x): v for (x, y), v in cells.items()}


def test_linear_ramps_stay_linear(spark):
    cells = {(x, y): 3.0 * x - y for x in range(8) for y in range(4)}
    got = {(r.x, r.y): r.value for r in P.resampled_linear(image(spark, cells), 8, 4, 16, 4).collect()}
    assert len(got) == 64
    assert all(math.isclose(v, 3 * ((x + 0.5) / 2 - 0.5) - y) for (x, y), v in got.items() if 0 < x < 15)


def test_background_of_corners_must_hang_together_and_be_large(spark):
    flat = {(x, y): 0 for x in range(6) for y in range(4)} | {(2, y): 5 for y in range(4)} | {(5, y): 7 for y in range(4)}
    tracks = spark.createDataFrame([(t, f, y, x) for t, f, y, x in [("left", 0, 1, 0), ("left", 1, 1, 0), ("mid", 0, 1, 3), ("right", 0, 1, 5)]], "track string, frame int, y int, x int")
    tracks = tracks.selectExpr("0 AS position", "*")
    px = image(spark, flat).selectExpr("0 AS position", "frame", "y", "x", "value")
    kept = lambda **k: {r.track for r in A.without_edge_tracks(tracks, px, 6, 4, ["position"], **k).collect()}
    assert kept() == {"left", "mid", "right"}  # eight and four pixels are too few for a background
    wide = image(spark, {(x, y): 0 for x in range(6) for y in range(4)}).selectExpr("0 AS position", "frame", "y", "x", "value")
    assert {r.track for r in A.without_edge_tracks(tracks, wide, 6, 4, ["position"]).collect()} == {"mid"}


def test_neighbours_of_positions(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "position string")
    assert {tuple(r) for r in S.neighbours(df).select("position", "previous", "next").collect()} == {("a", None, "b"), ("b", "a", "c"), ("c", "b", None)}


def test_planes_and_mixes(spark):
    stack = spark.createDataFrame([(0, z, 0, 0, float(z * z)) for z in (2, 3, 4, 7)], "frame int, z int, y int, x int, value double")
    plane = lambda which, **k: [r.value for r in P.planes(stack, which, **k).collect()]
    assert (plane("top"), plane("bottom"), plane("average"), len(plane("all"))) == ([4.0], [49.0], [19.5], 4)
    assert sorted(plane("interval", first=3, last=4)) == [9.0, 16.0]
    a, b = image(spark, {(0, 0): 1, (1, 0): 2}), image(spark, {(0, 0): 5})
    assert [r.value for r in P.mixed([(a, 2.0), (b, 1.0)], "max").collect()] == [5.0]
    assert [r.value for r in P.mixed([(a, 2.0), (b, 1.0)]).collect()] == [7.0]

"""Spots, outlines and metadata from elsewhere; filters of single frames in tracks; planes about the focus; correlation about pixels: hand-made cases and brute force."""

import random

import pytest

from lumentrack.operators import editing as G
from lumentrack.operators import measures as M
from lumentrack.operators import pixels as P
from lumentrack.operators import stencils as N
from lumentrack.operators import tracks as T
from lumentrack.sources import interchange as X


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([("p0", 0, 10, 0), ("p1", 1, 0, 5), ("p2", 2, 0, 0)], "parent string, frame int, ox int, oy int").cache()


@pytest.fixture(scope="module")
def imported(spark, parents):
    spots = [(1, 0, 2.0, 4.0, 0.0, 1.0, 0.5), (2, 0, 2.2, 4.0, 0.0, 1.0, 0.5), (3, 0, 50.0, 4.0, 0.0, 1.0, 0.5), (4, 1, 0.0, 0.0, 3.0, 2.0, None), (5, 9, 0.0, 0.0, 0.0, 1.0, 0.5)]
    return X.imported_spots(spark.createDataFrame(spots, "id int, frame int, x double, y double, z double, radius double, quality double"), parents, 0.5, 3.0).cache()


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame([(7, "p0", 0, 14.0, 9.0), (8, "p0", 0, 14.0, 9.9), (9, "p2", 2, 0.0, 0.0)], "id int, parent string, frame int, x double, y double").cache()


def test_spots_are_placed_in_their_parent(imported):
    assert rows(imported, "spot", "parent", "x", "y", "z", "radius") == [(1, "p0", 14.0, 8.0, 0.0, 2.0), (2, "p0", 14.4, 8.0, 0.0, 2.0), (3, "p0", 110.0, 8.0, 0.0, 2.0), (4, "p1", 0.0, 5.0, 1.0, 4.0)]


def test_the_nearest_spot_has_the_object(imported, objects):
    assert rows(X.matched_spots(imported, objects, 2.0), "spot", "object") == [(1, 7), (2, None), (3, None), (4, None)]
    assert rows(X.matched_spots(imported, objects, 1.0), "spot", "object") == [(1, None), (2, None), (3, None), (4, None)]  # the limit itself is too far


def test_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    spots = [(k, "p", rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(60)]
    there = [(k, "p", rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(40)]
    got = dict(rows(X.matched_spots(spark.createDataFrame(spots, "spot int, parent string, x double, y double"), spark.createDataFrame(there, "id int, parent string, x double, y double"), 1.7), "spot", "object"))
    nearest = {s: min(((x - u) ** 2 + (y - v) ** 2, o) for o, _, u, v in there) for s, _, x, y in spots}
    taken = {}
    for s, (far, o) in nearest.items():
        if far < 1.7:
            taken[o] = min(taken.get(o, (far, s)), (far, s))
    want = {s: None for s, *_ in spots} | {s: o for o, (_, s) in taken.items()}
    assert got == want and len(taken) > 10


def test_imports_replace_move_or_keep(imported, objects):
    matches = X.matched_spots(imported, objects, 2.0)
    run = lambda **o: rows(X.imported_objects(imported, objects, matches, **o), "id", "parent", "y", "spot")
    assert run(overwrite=True) == [("s1", "p0", 8.0, 1), ("s2", "p0", 8.0, 2), ("s3", "p0", 8.0, 3), ("s4", "p1", 5.0, 4)]
    assert run() == [("7", "p0", 8.0, 1), ("8", "p0", 9.9, None), ("s2", "p0", 8.0, 2), ("s3", "p0", 8.0, 3), ("s4", "p1", 5.0, 4)]
    assert run(track_only=True) == [("7", "p0", 9.0, 1), ("8", "p0", 9.9, None), ("9", "p2", 0.0, None), ("s2", "p0", 8.0, 2), ("s3", "p0", 8.0, 3), ("s4", "p1", 5.0, 4)]


def test_links_of_edges(spark):
    there = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("c", 1, 3), ("d", 2, 4), ("e", 2, 5), ("f", 3, None)], "id string, frame int, spot int")
    run = lambda *e: rows(X.imported_links(spark.createDataFrame(list(e), "a int, b int"), there), "src", "dst", "kind")
    assert run((1, 2), (2, 1), (2, 4), (2, 3), (1, 99)) == [("a", "b", "both"), ("b", "d", "both")]
    assert run((1, 2), (3, 1), (2, 4), (3, 4)) == [("a", "b", "previous"), ("a", "c", "previous"), ("b", "d", "next"), ("c", "d", "next")]
    assert run((4, 2), (5, 2), (4, 3)) == [("b", "d", "neither"), ("b", "e", "previous"), ("c", "d", "next")]


def test_export_undoes_import(spark, parents, imported):
    back = X.exported_spots(imported.selectExpr("spot AS id", "parent", "frame", "x", "y", "z", "pi() * radius * radius AS size", "quality"), parents, 0.5, 3.0, 60.0)
    got = [tuple(round(v, 9) for v in r) for r in rows(back, "id", "time", "x", "y", "z", "radius")]
    assert got == [(1, 0, 2, 4, 0, 1), (2, 0, 2.2, 4, 0, 1), (3, 0, 50, 4, 0, 1), (4, 60, 0, 0, 3, 2)]
    edges = spark.createDataFrame([(1, 4), (1, 4), (4, 5)], "src int, dst int")
    assert rows(X.exported_edges(edges, back), "a", "b") == [(1, 4)]


def test_outlines_by_parity(spark):
    shapes = {
        "square": [(0, 0), (3, 0), (3, 2), (0, 2)],
        "notch": [(0, 0), (8, 0), (8, 8), (4, 3.2), (0, 8)],
        "bow": [(0, 0), (6, 6), (6, 0), (0, 6)],
        "twice": [(0, 0), (4, 0), (4, 4), (0, 4)] * 2,
        "thin": [(0.1, 0.1), (0.4, 0.1), (0.4, 0.4)],
        "line": [(0, 0), (5, 5)],
        "none": [],
        "below": [(-3.5, -2.5), (1.5, -2.5), (-1.0, 2.5)],
    }
    df = spark.createDataFrame([(n, [dict(zip("xy", map(float, p), strict=True)) for p in v]) for n, v in shapes.items()], "o string, vertices array<struct<x: double, y: double>>")
    got = rows(X.outlined(df, ["o"]), "o", "y", "x")

    def inside(v, px, py):
        odd = False
        for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1], strict=True):
            if min(y0, y1) <= py < max(y0, y1) and x0 + (py - y0) * (x1 - x0) / (y1 - y0) <= px:
                odd = not odd
        return odd

    want = [(n, y, x) for n, v in shapes.items() for y in range(-5, 10) for x in range(-5, 10) if inside(v, x + 0.5, y + 0.5)]
    assert got == sorted(want, key=str) and {n for n, *_ in want} == {"square", "notch", "bow", "below"}


def test_metadata_wins_and_bad_json_adds_nothing(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}, '{"b": 3, "c": null}'), (2, {"a": "1"}, "not json"), (3, None, '{"z": true}'), (4, {}, None)], "id int, attributes map<string,string>, j string")
    got = {r.id: r.attributes for r in X.with_metadata(df, "j").collect()}
    assert got == {1: {"a": "1", "b": "3", "c": None}, 2: {"a": "1"}, 3: {"z": "true"}, 4: {}}
    assert X.with_metadata(df.drop("attributes"), "j").filter("id = 3").first().attributes == {"z": "true"}
    back = df.select("id", X.attributes_json("attributes").alias("t")).select("id", X.attributes_of("t").alias("a"))
    assert {r.id: r.a for r in back.collect()} == {1: {"a": "1", "b": "2"}, 2: {"a": "1"}, 3: None, 4: {}}


@pytest.fixture(scope="module")
def family(spark):
    """1 divides into 2 (large) and 3, 2 goes on to 4, 3 to 5; 6 is alone."""
    objects = spark.createDataFrame([(1, "f0", 0, 10.0), (2, "f1", 0, 9.0), (3, "f1", 1, 2.0), (4, "f2", 0, 9.0), (5, "f2", 1, 3.0), (6, "f2", 2, 1.0)], "id int, parent string, idx int, size double")
    links = spark.createDataFrame([(1, 2, "previous"), (1, 3, "previous"), (2, 4, "both"), (3, 5, "both")], "src int, dst int, kind string")
    return objects.cache(), links.cache(), spark.createDataFrame([(1, 1), (2, 2), (4, 2), (3, 3), (5, 3), (6, 6)], "id int, track_head int")


@pytest.mark.parametrize(
    ("gone", "how", "merge", "left", "links"),
    [
        (3, "single", "always", [(1, 0), (2, 0), (4, 0), (5, 1), (6, 2)], [(1, 2, "both"), (2, 4, "both")]),
        (3, "single", "never", [(1, 0), (2, 0), (4, 0), (5, 1), (6, 2)], [(1, 2, "previous"), (2, 4, "both")]),
        (3, "single", "size", [(1, 0), (2, 0), (4, 0), (5, 1), (6, 2)], [(1, 2, "both"), (2, 4, "both")]),
        (2, "single", "size", [(1, 0), (3, 0), (4, 0), (5, 1), (6, 2)], [(1, 3, "previous"), (3, 5, "both")]),
        (3, "prune", "always", [(1, 0), (2, 0), (4, 0), (6, 1)], [(1, 2, "both"), (2, 4, "both")]),
        (5, "track", "size", [(1, 0), (2, 0), (4, 0), (6, 1)], [(1, 2, "both"), (2, 4, "both")]),
        (99, "track", "always", [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 2)], [(1, 2, "previous"), (1, 3, "previous"), (2, 4, "both"), (3, 5, "both")]),
    ],
)
def test_what_goes_with_a_deleted_object(spark, family, gone, how, merge, left, links):
    o, ls = G.post_filtered(family[0], family[1], spark.createDataFrame([(gone,)], "id int"), how, merge, family[2])
    assert rows(o, "id", "idx") == left and rows(ls, "src", "dst", "kind") == links


def test_unknown_ways_raise(spark, family):
    for how, merge in (("all", "always"), ("single", "sometimes")):
        with pytest.raises(ValueError):
            G.post_filtered(family[0], family[1], family[0].select("id"), how, merge)


def test_planes_about_the_focus(spark):
    px = spark.createDataFrame([("s", z, 0, x, float(x * (5 - abs(z - 13)))) for z in range(10, 16) for x in range(3)], "s string, z int, y int, x int, value double")
    zs = lambda a, b: sorted({(r.z, r.value) for r in N.around_focus(px, a, b, keys=["s"]).filter("x = 1").collect()})
    assert zs(-1, 1) == [(0, 4.0), (1, 5.0), (2, 4.0)] and zs(1, 9) == [(0, 4.0), (1, 3.0)] and zs(7, 9) == []


@pytest.mark.parametrize("radius", [1.0, 1.5, 2.0, 2.6])
def test_correlation_about_pixels(spark, radius):
    rng = random.Random(int(radius * 10))
    cells = {(k, y, x): rng.random() for k in (0, 1) for y in range(7) for x in range(7) if rng.random() < 0.7} | {(2, 0, 0): 4.0, (3, 0, 0): 1.0, (3, 0, 1): 1.0}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "o int, y int, x int, value double")
    got = {r.o: (r.pairs, round(r.correlation, 9)) for r in N.radial_autocorrelation(df, [radius], ["o"]).collect()}
    reach = int(radius + 0.5)
    for o in range(4):
        px = {(y, x): v for (k, y, x), v in cells.items() if k == o}
        mean = sum(px.values()) / len(px)
        var = sum((v - mean) ** 2 for v in px.values()) / len(px)
        found = [(v - mean) * (px[y + dy, x + dx] - mean) for (y, x), v in px.items() for dy in range(reach + 1) for dx in range(-reach, reach + 1) if (dy or dx > -reach) and (radius - 1) ** 2 < dx * dx + dy * dy <= radius**2 and (y + dy, x + dx) in px]
        assert got[o] == (len(found), round(sum(found) / len(found) / var, 9) if found and var else 0.0)


def test_objects_cut_off_at_the_open_end(spark):
    frame = lambda k: [(k, y, x) for y in range(10) for x in range(6)]
    parents = spark.createDataFrame(frame(0) + frame(1), "frame int, y int, x int")
    cells = [(0, 1, y, x) for y in range(2, 8) for x in (2, 3)]  # whole
    cells += [(0, 2, y, x) for y in (8, 9) for x in (2, 3)]  # small, at the end
    cells += [(0, 3, y, 5) for y in range(6)]  # along the right side
    cells += [(1, 1, 9, x) for x in range(6)]  # alone in its frame
    mask = spark.createDataFrame(cells, "frame int, object_id int, y int, x int")
    run = lambda **o: rows(M.trimmed_at_end(mask, parents, ["frame"], **o), "frame", "object_id")
    assert run(size=5) == [(0, 2)] and run(size=0, share=9.0) == [] and run(size=5, keep_only=False) == [(0, 2), (1, 1)]
    assert run(size=0, side_share=2.0) == [(0, 2), (0, 3)] and run(share=0) == []
    assert run(size=0, share=0, side_share=2.0) == [(0, 3)]


@pytest.mark.parametrize("seed", [1])
def test_pruning_goes_through_merges_and_long_tracks(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 40)] + [(k, k + rng.randrange(1, 30)) for k in rng.sample(range(60, 160), 70)] * 2
    edges += [(rng.randrange(41), rng.randrange(170, 180)) for _ in range(3)] + [(k, k + 1) for k in range(180, 183)]
    roots = [rng.randrange(20, 40), rng.randrange(60, 120), 181, 999]
    gone, front = set(roots), list(roots)
    while front:
        x = front.pop()
        for a, b in edges:
            if a == x and b not in gone:
                gone.add(b)
                front.append(b)
    ids = lambda v: spark.createDataFrame([(k,) for k in v], "id int")
    links = spark.createDataFrame(edges, "src int, dst int")
    assert {r.id for r in T.pruned(ids(range(200)), links, ids(roots)).collect()} == set(range(200)) - gone
    assert T.pruned(ids(range(9)), links.filter("false"), ids([3])).count() == 8


def test_pruning_raises_on_rings(spark):
    with pytest.raises(ValueError):
        ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
        T.pruned(ring.selectExpr("src AS id"), ring, spark.createDataFrame([(9,)], "id int"))


def test_correction_needs_the_images_given(spark):
    px = spark.createDataFrame([(0, 0, 0, 7.0), (0, 0, 1, 9.0)], "frame int, y int, x int, value double")
    flat = spark.createDataFrame([(0, 0, 2.0)], "y int, x int, value double")
    run = lambda *o: [r.value for r in P.background_corrected(px, *o).orderBy("x").collect()]
    assert run() == [7.0, 9.0] and run(flat) == [3.5, None] and run(None, flat, 1.0, 2.0) == [2.0, None]
    assert run(flat.withColumn("value", P.F.lit(0.0))) == [None, None]

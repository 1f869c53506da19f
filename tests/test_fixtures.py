"""Hand-made cases, and brute force for what SQL can't say."""

import math
from collections import Counter
import random

import numpy as np
from pyspark.sql import functions as F

from lumentrack.functions import scalars as fn
from lumentrack.functions.components import connected_components
from lumentrack.functions.ranking import global_rank
from lumentrack.operators import histograms as H
from lumentrack.operators import linking as L
from lumentrack.operators import measures as M
from lumentrack.operators import pixels as P
from lumentrack.operators import selections as S
from lumentrack.operators import spatial as J
from lumentrack.operators import stencils as N
from lumentrack.operators import tracks as T
from lumentrack.sources import readers, sinks


def px(spark, cells, frame=0):
    return spark.createDataFrame([(frame, y, x, float(v)) for (x, y), v in cells.items()], "frame int, y int, x int, value double")


def test_distance_transform_of_known_mask(spark):
    cells = {(x, y): 1 for x in range(4) for y in (1, 2, 3)} | {(1, 0): 1}
    d = {(r.x, r.y): r.distance for r in N.distance_transform(px(spark, cells), 10, 10, scale=0.1).collect()}
    assert math.isclose(d[1, 0], 0.1) and math.isclose(d[0, 2], 0.1) and math.isclose(d[1, 2], 0.2) and math.isclose(d[1, 1], 0.1 * math.sqrt(2))


def labelled(cells, low):
    left, n = set(cells), 0
    while left:
        n += 1
        front = [left.pop()]
        while front:
            x, y = front.pop()
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (not low or dx * dy == 0) and (x + dx, y + dy) in left:
                        left.remove((x + dx, y + dy))
                        front.append((x + dx, y + dy))
    return n


def test_components_against_flood_fill(spark):
    rng = random.Random(4)
    cells = {(x, y): 1 for x in range(20) for y in range(15) if rng.random() < 0.45}
    for low in (False, True):
        found = P.components(px(spark, cells), low=low)
        assert found.select("object_id").distinct().count() == labelled(cells, low)
        assert found.count() == len(cells)


def test_components_of_a_diagonal(spark):
    m = px(spark, {(0, 0): 1, (1, 1): 1})
    assert P.components(m).select("object_id").distinct().count() == 1
    assert P.components(m, low=True).select("object_id").distinct().count() == 2


def test_fill_holes(spark):
    ring = {(x, y): 1 for x in range(1, 5) for y in range(1, 5)}
    del ring[2, 2]
    assert N.filled_holes(px(spark, ring), 8, 8).count() == 16


def test_connected_components_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {a: find(a) for a in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "é", "B", "a"]], "s string")
    got = [r.s for r in global_rank(df, F.col("s").asc_nulls_last(), "k").orderBy("k").collect()]
    assert got == ["B", "a", "a", "b", "é", None]


def test_track_heads_of_merges_and_divisions(spark):
    key = lambda f, i: f * 10 + i
    both = [(key(f, 0), key(f + 1, 0)) for f in range(4)] + [(key(f, 1), key(f + 1, 1)) for f in (1, 2, 3)]
    both += [(key(3, 2), key(4, 2)), (key(0, 1), key(1, 2)), (key(1, 2), key(2, 2))]
    divided = [(key(0, 0), key(1, 1)), (key(2, 1), key(3, 2))]
    links = [(*link, "both") for link in both] + [(*link, "previous") for link in divided]
    objects = spark.createDataFrame([(key(f, i),) for f in range(5) for i in range(3)], "id long")
    heads = {r.id: r.track_head for r in T.track_heads(objects, spark.createDataFrame(links, "src long, dst long, kind string")).collect()}
    sizes = Counter(heads.values())
    assert {h: sizes[h] for h in (key(0, 0), key(0, 1), key(0, 2), key(1, 1), key(3, 2))} == {key(0, 0): 5, key(0, 1): 3, key(0, 2): 1, key(1, 1): 4, key(3, 2): 2}
    assert sum(sizes.values()) == 15 and len(sizes) == 5


def test_regression_and_displacement(spark):
    df = spark.createDataFrame([(1, float(x), 2 * math.exp(0.5 * x)) for x in range(4)], "track int, hours double, size double")
    row = T.growth_rate(df).first()
    assert math.isclose(row.growth_rate, 0.5) and math.isclose(row.size_at_birth, 2)
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 2.0), (1, 4, 4.0, 2.0)], "track int, n int, x double, y double")
    got = {r.lag: (r.pairs, r.msd) for r in T.displacement(points, [1, 2]).collect()}
    assert got == {1: (2, 2.5), 2: (2, 7.0)}


def test_histogram_edge_and_quantile(spark):
    h = H.fixed_bins(spark.createDataFrame([(1, float(v)) for v in (0, 0, 1, 2, 4)], "k int, value double"), ["k"], 0.0, 1.0, 4)
    assert {r.bin: r["count"] for r in h.collect()} == {0: 2, 1: 1, 2: 1, 3: 1}


def test_colocalisation_of_a_multiple(spark):
    df = spark.createDataFrame([(1, float(a), 2.0 * a) for a in (1, 2, 3, 4)], "k int, a double, b double")
    row = M.colocalisation(df, ["k"], "a", "b", 0, 0).first()
    assert math.isclose(row.pearson, 1) and math.isclose(row.overlap, 1) and math.isclose(row.k1, 2) and math.isclose(row.k2, 0.5)


def test_selection_algebra_and_empty_tables(spark):
    schema = "position string, indices string"
    a, b = (spark.createDataFrame([("p", i) for i in x], schema) for x in (["0-1", "0-2", "1-1"], ["0-2", "1-1", "1-9"]))
    assert S.union(a, b).count() == 4 and S.intersection(a, b).count() == 2
    assert [r.indices for r in S.difference(a, b).collect()] == ["0-1"]
    none = spark.createDataFrame([], schema)
    assert S.union(none, none).count() == 0 and S.difference(a, none).count() == 3


def test_predicate_on_absent_values(spark):
    df = spark.createDataFrame([(1, "3", "true"), (2, "x", "no"), (3, None, None), (4, "nan", "True")], "id int, v string, f string")
    assert [r.id for r in df.filter(S.predicate({"column": "v", "over": 2})).orderBy("id").collect()] == [1, 4]
    assert [r.id for r in df.filter(S.predicate({"column": "f", "is": True})).orderBy("id").collect()] == [1, 4]
    assert df.filter(S.predicate({"all": []})).count() == 4 and df.filter(S.predicate({"any": []})).count() == 0


def test_mutual_best_is_greedy_by_cost(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(12), rng.randrange(12)): rng.random() for _ in range(60)}
    want, a, b = set(), set(), set()
    for (s, d), c in sorted(pairs.items(), key=lambda x: (x[1], x[0])):
        if s not in a and d not in b:
            want.add((s, d))
            a.add(s)
            b.add(d)
    got = L.mutual_best(spark.createDataFrame([(s, d, c) for (s, d), c in pairs.items()], "src int, dst int, cost double"))
    assert {(r.src, r.dst) for r in got.collect()} == want


def test_without_close_keeps_the_better(spark):
    rng = random.Random(3)
    points = [(i, 0, rng.random() * 30, rng.random() * 30, rng.random()) for i in range(60)]
    kept = []
    for p in sorted(points, key=lambda p: (-p[4], p[0])):
        if all(math.dist(p[2:4], q[2:4]) >= 5 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(points, "id int, frame int, x double, y double, quality double")
    assert {r.id for r in J.without_close(df, 5.0, ["frame"]).collect()} == {p[0] for p in kept}


def test_arrays_and_paths(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 4.0],)], "v array<double>")
    v = F.col("v")
    row = df.select(fn.argmax(v), fn.argmin(v), fn.array_mean(v), fn.array_sigma(v), fn.array_quantile(v, 0.25), fn.array_mad(v), fn.first_where(v, lambda x: x > 3), fn.first_where(v, lambda x: x > 9)).first()
    assert row[:2] == (1, 0) and row[2] == 2.75 and math.isclose(row[3], np.std([1, 4, 2, 4])) and math.isclose(row[4], np.quantile([1, 4, 2, 4], 0.25)) and row[5] == 1.0 and row[6:] == (1, -1)
    row = spark.range(1).select(fn.roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)), fn.roots(F.lit(0.0), F.lit(2.0), F.lit(-4.0)), fn.roots(F.lit(1.0), F.lit(0.0), F.lit(1.0)), fn.path_text(fn.path_parent(F.array(F.lit(3), F.lit(1), F.lit(4)))), fn.printed(F.lit(float("nan"))), fn.letter(F.lit(25))).first()
    assert list(row) == [[1.0, 2.0], [2.0], [], "3-1", "NA", "B1"]


def test_readers_and_writers(spark, tmp_path):
    s = spark.createDataFrame([("a", 1, "p1", "0-1"), ("a", 1, "p2", "0-2"), ("b", 1, "p1", "3-1"), ("b", 2, "p1", "3-2")], "name string, oc int, position string, indices string")
    sinks.write_table(sinks.selection_table(s), str(tmp_path / "csv"), order=["Position", "Indices"])
    back = readers.selections_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))
    assert [r.name for r in readers.mixed_classes(back).collect()] == ["b"]
    (tmp_path / "s.json").write_text('{"name": "a", "structureIdx": 3, "objects": {"p": ["0-1", "0-2"]}}\n')
    assert sorted(r.indices for r in readers.selections_json(spark, str(tmp_path / "s.json")).collect()) == ["0-1", "0-2"]
    (tmp_path / "d.json").write_text('{"id": 1}\nnot json\n')
    good, bad = readers.documents_json(spark, str(tmp_path / "d.json"), "id int")
    assert [r.id for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "t.txt").write_text("1 0 1 0\n2 2 3 1\n")
    objects = spark.createDataFrame([(10, 1, 0), (11, 1, 1), (20, 2, 2), (21, 2, 3)], "id int, label int, frame int")
    links = readers.links_of_labels(objects, readers.track_table(spark, str(tmp_path / "t.txt")))
    assert {tuple(r) for r in links.collect()} == {(10, 11, "track"), (20, 21, "track"), (11, 20, "division")}
    files = readers.catalogue(spark.createDataFrame([("/a/xy1_t0_c0.tif",), ("/a/xy1_t1_c1.tif",), ("/a/odd.tif",)], "path string"))
    assert readers.incomplete(files.filter("position is not null")).count() == 2


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, sinks.upserted(new, old, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]

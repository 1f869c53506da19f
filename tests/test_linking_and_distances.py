"""Assignments, nearest objects, distances, gates and lineages against brute force on small cases."""

import itertools
import math
import random

import numpy as np
import pytest

from lumentrack.operators import histograms as H
from lumentrack.operators import linking as L
from lumentrack.operators import pixels as P
from lumentrack.operators import populations as A
from lumentrack.operators import spatial as J
from lumentrack.operators import stencils as N
from lumentrack.operators import tracks as T


def test_components_of_groups_with_long_names(spark):
    cells = [("experiment_A_xy01", 0, 0), ("experiment_A_xy01", 0, 4), *[("experiment_A_xy02", 0, x) for x in range(5)], ("experiment_A_xy0", 3, 3)]
    got = P.components(spark.createDataFrame(cells, "position string, y int, x int"), ["position"]).collect()
    assert {(r.position, r.x, r.object_id) for r in got if r.position == "experiment_A_xy01"} == {("experiment_A_xy01", 0, 1), ("experiment_A_xy01", 4, 2)}
    assert {r.object_id for r in got if r.position == "experiment_A_xy02"} == {1}


def best_total(pairs, no_link):
    src, dst = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    least = math.inf
    for to in itertools.product([None, *dst], repeat=len(src)):
        taken = [t for t in to if t is not None]
        if len(taken) == len(set(taken)) and all(t is None or (s, t) in pairs for s, t in zip(src, to, strict=True)):
            least = min(least, sum(pairs[s, t] for s, t in zip(src, to, strict=True) if t is not None) + no_link * (len(src) + len(dst) - 2 * len(taken)))
    return least


def total(links, pairs, no_link):
    assert len({r.src for r in links}) == len({r.dst for r in links}) == len(links)
    ends = len({a for a, _ in pairs}) + len({b for _, b in pairs})
    return sum(r.cost for r in links) + no_link * (ends - 2 * len(links))


@pytest.mark.parametrize("most", [2000, 0])
def test_assignments_cost_least(spark, most):
    rng, rows, wanted = random.Random(most), {}, []
    for k in range(12):
        pairs = {(10 * k + i, 10 * k + j): float(rng.randint(0, 12)) for i in range(4) for j in range(rng.randint(1, 5)) if rng.random() < 0.7}
        rows |= pairs
        wanted.append(pairs)
    df = spark.createDataFrame([(*p, c) for p, c in rows.items()] + [(*p, c + 1) for p, c in rows.items()] + [(None, 1, 0.0)], "src int, dst int, cost double")
    links = L.assigned(df, 5.0, most=most, step=0.2 if most == 0 else 1e-3).collect()
    for k, pairs in enumerate(wanted):
        assert total([r for r in links if r.src // 10 == k], pairs, 5.0) == best_total(pairs, 5.0)


def test_assignments_of_nothing(spark):
    assert L.assigned(spark.createDataFrame([], "src int, dst int, cost double"), 1.0).count() == 0


def test_most_gain_of_random_tables():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        gain = np.where(rng.random((n, m)) < 0.8, rng.integers(1, 9, (n, m)), -np.inf).astype(float)
        to = L.most_gain(gain)
        assert len(set(to[to >= 0])) == (to >= 0).sum()
        best = max(sum(gain[i, j] for i, j in enumerate(c) if j >= 0) for c in itertools.product(range(-1, m), repeat=int(n)) if len({j for j in c if j >= 0}) == sum(j >= 0 for j in c) and all(j < 0 or gain[i, j] > 0 for i, j in enumerate(c)))
        assert sum(gain[i, j] for i, j in enumerate(to) if j >= 0) == best


def test_gaps_splits_and_merges(spark):
    points = [(1, 0, 0.0, 0.0), (2, 1, 0.5, 0.0), (3, 3, 1.0, 0.0), (11, 0, 50.0, 0.0), (12, 1, 50.0, 0.0), (13, 2, 49.0, 0.0), (14, 2, 51.5, 0.0), (21, 0, 90.0, 0.0), (22, 0, 93.0, 0.0), (23, 1, 91.0, 0.0)]
    df = spark.createDataFrame(points, "id int, frame int, x double, y double")
    kinds = lambda **k: {(r.src, r.dst): r.kind for r in L.linked(df, 5.0, **k).collect()}
    plain = {(1, 2): "link", (11, 12): "link", (12, 13): "link", (21, 23): "link"}
    assert kinds() == plain
    assert kinds(max_gap=1, splits=True, merges=True) == plain | {(2, 3): "gap", (12, 14): "split", (22, 23): "merge"}
    assert kinds(splits=True) == plain | {(12, 14): "split"}


@pytest.mark.parametrize("same", [True, False])
def test_nearest_of_clusters_and_repeated_places(spark, same):
    rng = random.Random(3)
    places = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(60)] + [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(30)] + [(7.0, 7.0)] * 20
    points = [("g", i, x, y) for i, (x, y) in enumerate(places)] + [("one", 900, 1.0, 1.0), ("line", 901, 0.0, 5.0), ("line", 902, 100.0, 5.0)]
    others = points if same else [(g, i + 1000, x + rng.choice([0.0, 300.0]), y) for g, i, x, y in points if i % 3]
    schema = "frame string, id int, x double, y double"
    got = {(r.frame, r.id): (r.nearest_id, r.distance) for r in J.nearest(spark.createDataFrame(points, schema), spark.createDataFrame(others, schema), ["frame"], same).collect()}
    want = {}
    for g, i, x, y in points:
        found = [((x - b) ** 2 + (y - c) ** 2, j) for h, j, b, c in others if h == g and (not same or j != i)]
        if found:
            want[g, i] = min(found)
    assert got.keys() == want.keys()
    for k, (d2, j) in want.items():
        assert got[k][0] == j and math.isclose(got[k][1], math.sqrt(d2), abs_tol=1e-9)


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("border", [True, False])
def test_distances_in_three_dimensions(spark, inside, border):
    rng = random.Random(8)
    w, h, d, step, step_z = 9, 7, 5, 0.5, 1.3
    mask = {(x, y, z) for x in range(w) for y in range(h) for z in range(d) if rng.random() < 0.7}
    got = {(r.x, r.y, r.z): r.distance for r in N.distance_transform(spark.createDataFrame([(0, x, y, z) for x, y, z in mask], "frame int, x int, y int, z int"), w, h, scale=step, depth=d, scale_z=step_z, inside=inside, border=border).collect()}
    image = {(x, y, z) for x in range(w) for y in range(h) for z in range(d)}
    asked, targets = (mask, image - mask) if inside else (image - mask, mask)
    if inside and border:
        targets = targets | {(x, y, z) for x in range(-1, w + 1) for y in range(-1, h + 1) for z in range(-1, d + 1)} - image
    assert got.keys() == asked
    for a in asked:
        assert math.isclose(got[a], min(math.sqrt(sum(((p - q) * s) ** 2 for p, q, s in zip(a, t, (step, step, step_z), strict=True))) for t in targets), abs_tol=1e-9)


def test_distance_without_anything_outside(spark):
    full = spark.createDataFrame([(0, x, y) for x in range(3) for y in range(3)], "frame int, x int, y int")
    assert {r.distance for r in N.distance_transform(full, 3, 3, border=False).collect()} == {None}
    assert N.distance_transform(full.filter("false"), 3, 3).count() == 0


def pixels(spark, rows):
    return spark.createDataFrame([(0, o, y, x) for o, y, x in rows], "frame int, object_id int, y int, x int")


def test_gate_takes_the_partner_of_largest_box_overlap(spark):
    a = pixels(spark, [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 9, 9)])
    b = pixels(spark, [(7, 1, 1), (7, 2, 2), (8, 0, 0), (8, 0, 1), (8, 0, 2)])
    of = lambda gate: {(r.object_id, r.y, r.x) for r in A.gated(a, b, gate).collect()}
    assert of("a+b") == {(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (1, 0, 2), (2, 9, 9)}
    assert of("a-b") == {(1, 1, 0), (1, 1, 1), (2, 9, 9)}
    assert of("b-a") == {(1, 0, 2)}


def test_saturated_tracks(spark):
    full, dim = [(0, 10), (1, 4), (5, 1), (9, 5)], [(0, 10), (5, 8), (9, 1)]
    rows = [("a", 1, *b) for b in full] + [("a", 2, *b) for b in dim] + [("b", 1, *b) for b in dim] + [("c", 1, 0, 99)]
    hist = spark.createDataFrame(rows, "track string, object_id int, bin int, count long")
    assert [r.track for r in A.saturated_tracks(hist, 0.5, 0.5).collect()] == ["a"]
    assert A.saturated_tracks(hist, 0.5, 0.6).count() == 0


def test_lineages_of_a_deep_chain_and_of_many_daughters(spark):
    rows = [(0, None, 0, 0.0)] + [(i, i - 1, i, 0.0) for i in range(1, 1000)] + [(5000, None, 1, 3.0), (7000, 6999, 2, 0.0)] + [(5001 + i, 5000, 5, float(-i)) for i in range(14)]
    got = {r.track: r.lineage for r in T.lineage_labels(spark.createDataFrame(rows, "track int, parent int, start int, y double")).collect()}
    assert got[0] == "A" and got[999] == "A" + "H" * 999 and got[5000] == "B" and got[7000] == "C"
    assert [got[5014 - i] for i in range(14)] == ["BH", *(f"B{c}" for c in "IJKLMNOPQRS"), "B-", "BT"]


def test_ancestors_in_a_ring_are_an_error(spark):
    rows = [(1, None, 0, 0.0), (2, 3, 0, 0.0), (3, 2, 0, 0.0)]
    with pytest.raises(ValueError, match="own ancestors"):
        T.lineage_labels(spark.createDataFrame(rows, "track int, parent int, start int, y double"))


def flood(cells, low):
    left, n = set(cells), 0
    while left:
        n += 1
        front = [left.pop()]
        while front:
            x, y = front.pop()
            for dx, dy in itertools.product((-1, 0, 1), repeat=2):
                if (not low or dx * dy == 0) and (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    front.append((x + dx, y + dy))
    return n


@pytest.mark.parametrize("low", [True, False])
def test_objects_at_every_threshold(spark, low):
    rng = random.Random(11)
    images = {f: {(x, y): float(rng.randint(0, 6)) for x in range(9) for y in range(7) if rng.random() < 0.9} for f in range(3)} | {9: {(0, 0): 1.0}}
    df = spark.createDataFrame([(f, y, x, v) for f, cells in images.items() for (x, y), v in cells.items()], "frame int, y int, x int, value double")
    got = {(r.frame, r.value): r.objects for r in H.object_counts(df, low=low).collect()}
    want = {(f, t): flood([c for c, v in cells.items() if v >= t], low) for f, cells in images.items() for t in set(cells.values())}
    assert got == want
    for most in (1, 4):
        limits = {r.frame: (r.threshold, r.objects) for r in H.threshold_by_objects(df, most, low=low).collect()}
        for f, cells in images.items():
            fine = None
            for t in sorted(set(cells.values()), reverse=True):
                if want[f, t] > most:
                    break
                fine = t
            assert limits.get(f) == (None if fine is None else (fine, want[f, fine]))


def test_percentiles_of_one_large_group_and_of_ties(spark):
    rng = random.Random(12)
    values = {"large": [math.exp(rng.gauss(0, 4)) for _ in range(3000)], "ties": [1.0] * 500 + [2.0] * 500, "one": [3.0], "two": [1.0, 2.0], "wide": [-1e308, 0.0, 1e308]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("large", None), ("none", None), ("large", float("nan"))]
    qs = [0.0, 0.31, 0.5, 0.999, 1.0]
    got = {(r.k, r.q): r.percentile for r in H.exact_percentiles(spark.createDataFrame(rows, "k string, value double"), ["k"], qs, few=16, bins=8).collect()}
    assert {k for k, _ in got} == set(values)
    for (k, q), v in got.items():
        if k != "wide":
            assert math.isclose(v, np.quantile(values[k], q), rel_tol=1e-12)
    assert got["wide", 0.5] == 0.0 and got["wide", 1.0] == 1e308
    assert H.exact_percentiles(spark.createDataFrame(rows, "k string, value double").filter("k = 'two'"), [], [0.25]).collect()[0].percentile == 1.25


def test_local_thickness_is_the_largest_ball_over_each_pixel(spark):
    rng = random.Random(13)
    cells = {(x, y) for x in range(14) for y in range(12) if rng.random() < 0.93 or 4 < x < 10}
    df = spark.createDataFrame([(0, y, x) for x, y in cells], "frame int, y int, x int")
    out = {(x, y) for x in range(-1, 15) for y in range(-1, 13)} - cells
    r2 = {c: min((c[0] - o[0]) ** 2 + (c[1] - o[1]) ** 2 for o in out) for c in cells}
    want = {p: 2 * math.sqrt(max(r for c, r in r2.items() if (c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2 < r)) for p in cells}
    got = {(r.x, r.y): r.thickness for r in N.local_thickness(df, 14, 12).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)

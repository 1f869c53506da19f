"""Costs by shape, links that don't cross, thresholds by colocalisation: against brute force."""

import itertools
import math
import random

import pytest

from lumentrack.operators import linking as L
from lumentrack.operators import measures as M
from lumentrack.operators import stencils as N

LINK = "frame int, src long, dst long, x0 double, x1 double, weight double"


def crossed(a, b):
    return (a[3] - b[3]) * (a[4] - b[4]) <= 0


def heaviest(links):
    best = 0.0
    for k in range(len(links) + 1):
        for chosen in itertools.combinations(links, k):
            if not any(crossed(a, b) for a, b in itertools.combinations(chosen, 2)):
                best = max(best, sum(c[5] for c in chosen))
    return best


def test_uncrossed_is_the_heaviest_set(spark):
    rng = random.Random(3)
    links = [(f, 100 * f + i, 100 * f + 50 + i, float(rng.randrange(9)), float(rng.randrange(9)), rng.choice([0.5, 1.0, 2.5])) for f in range(40) for i in range(rng.randrange(1, 10))]
    got = [tuple(r) for r in L.uncrossed(spark.createDataFrame(links, LINK)).collect()]
    assert set(got) <= set(links) and len(set(got)) == len(got)
    for f in range(40):
        mine = [g for g in got if g[0] == f]
        assert not any(crossed(a, b) for a, b in itertools.combinations(mine, 2))
        assert sum(g[5] for g in mine) == pytest.approx(heaviest([x for x in links if x[0] == f]))
    assert sorted(got) == sorted(tuple(r) for r in L.uncrossed(spark.createDataFrame(links[::-1], LINK).repartition(7)).collect())


def test_uncrossed_leaves_what_does_not_cross_and_drops_what_is_no_link(spark):
    links = [(0, i, 1000 + i, float(i), i + 0.5, 1.0) for i in range(300)] + [(1, 1, 2, None, 1.0, 1.0), (1, 3, 4, 1.0, 1.0, 0.0), (1, None, 4, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(links, LINK)
    assert L.uncrossed(df).count() == 300
    assert L.uncrossed(df.filter("false")).count() == 0
    one = spark.createDataFrame([("a", *links[0]), ("b", 0, 9, 8, 5.0, 0.0, 1.0)], "position string, " + LINK)
    assert L.uncrossed(one, ["position"]).count() == 2  # of different positions, so they don't cross


def test_links_on_an_axis_close_gaps_and_never_cross(spark):
    """Four channels that all move by 3; the second is absent for two frames, the third for one."""
    points = [(f * 10 + c, f, 20.0 * c + 3 * f) for f in range(6) for c in range(4) if not (c == 1 and f in (2, 3)) and not (c == 2 and f == 4)]
    df = spark.createDataFrame(points, "id long, frame int, x double")
    got = {(r.src, r.dst): r.kind for r in L.linked_on_axis(df, 12.0, max_gap=2).collect()}
    frames = {}
    for i, f, _ in points:
        frames.setdefault(i % 10, []).append((f, i))
    want = {(a[1], b[1]): "link" if b[0] - a[0] == 1 else "gap" for v in frames.values() for a, b in itertools.pairwise(sorted(v))}
    assert got == want
    assert set(L.linked_on_axis(df, 12.0).select("kind").distinct().toPandas()["kind"]) == {"link"}
    keyed = df.selectExpr("'p' AS position", "*")
    assert {(r.src, r.dst): r.kind for r in L.linked_on_axis(keyed, 12.0, ["position"], max_gap=2).collect()} == want


def test_a_gap_that_crosses_links_is_left_out(spark):
    """1 ends left of the track 2-3-4, 5 begins right of it."""
    points = [(1, 0, 0.0), (2, 0, 5.0), (3, 1, 5.0), (4, 2, 5.0), (5, 2, 9.0)]
    df = spark.createDataFrame(points, "id long, frame int, x double")
    rows = L.linked_on_axis(df, 4.0, max_gap=1).collect()
    assert {(r.src, r.dst, r.kind) for r in rows} == {(2, 3, "link"), (3, 4, "link")}
    wide = {(r.src, r.dst, r.kind) for r in L.linked_on_axis(df.filter("id not in (2, 3, 4)"), 9.5, max_gap=1).collect()}
    assert wide == {(1, 5, "gap")}


def test_random_links_on_an_axis_never_cross(spark):
    rng = random.Random(8)
    points = [(f * 100 + i, f, round(rng.uniform(0, 60), 2)) for f in range(8) for i in range(6)]
    place = {i: (f, x) for i, f, x in points}
    rows = L.linked_on_axis(spark.createDataFrame(points, "id long, frame int, x double"), 12.0, max_gap=2).collect()
    assert len({r.src for r in rows}) == len({r.dst for r in rows}) == len(rows) > 10
    for a, b in itertools.combinations(rows, 2):
        (fa, xa), (ga, ya), (fb, xb), (gb, yb) = place[a.src], place[a.dst], place[b.src], place[b.dst]
        at = lambda f, f0, x0, f1, x1: x0 + (x1 - x0) * (f - f0) / (f1 - f0)
        for f in range(max(fa, fb), min(ga, gb)):
            left, right = at(f, fa, xa, ga, ya) - at(f, fb, xb, gb, yb), at(f + 1, fa, xa, ga, ya) - at(f + 1, fb, xb, gb, yb)
            assert left * right > 0


def blobs(seed, n=5):
    rng = random.Random(seed)
    return sorted({(f, o, 10 * f + o + rng.randrange(6), 7 * o + rng.randrange(5)) for f in range(3) for o in range(n) for _ in range(rng.randrange(1, 12))})


@pytest.mark.parametrize("average", [False, True])
def test_hausdorff_costs(spark, average):
    points = blobs(1)
    of = {}
    for f, o, y, x in points:
        of.setdefault((f, o), []).append((y, x))
    want = {}
    for (f, a), p in of.items():
        for (g, b), q in of.items():
            if g == f + 1:
                there, back = ([min((y - v) ** 2 + (x - u) ** 2 for v, u in t) for y, x in s] for s, t in ((p, q), (q, p)))
                if max(there + back) <= 14.5**2:
                    want[g, a, b] = max(sum(d) / len(d) for d in (there, back)) if average else max(there + back)
    df = spark.createDataFrame(points + points[:3], "frame int, object_id int, y int, x int")
    got = {(r.frame, r.src, r.dst): r.cost for r in L.hausdorff_costs(df, 14.5, average=average).collect()}
    assert got == pytest.approx(want) and len(want) > 5
    assert L.hausdorff_costs(df.filter("false"), 5.0).count() == 0


def test_overlap_costs_of_parts(spark):
    """A square of 4 becomes two halves of 2."""
    rows = [(0, 1, y, x) for y in (0, 1) for x in (0, 1)] + [(1, x, y, x) for y in (0, 1) for x in (0, 1)]
    df = spark.createDataFrame(rows + rows[:1], "frame int, object_id int, y int, x int")
    cost = lambda mode: {(r.src, r.dst): (r.overlap, r.cost) for r in L.overlap_costs(df, mode=mode).collect()}
    assert cost("link") == cost("merge") == {(1, 0): (2, 0.5), (1, 1): (2, 0.5)}
    assert cost("split") == {(1, 0): (2, 0.0), (1, 1): (2, 0.0)}
    with pytest.raises(ValueError):
        L.overlap_costs(df, mode="other")


def test_fields_of_points(spark):
    points = [("a", -3, 2), ("a", 0, 9), ("b", 5, 5)]
    field = {(r.k, r.y, r.x): r.distance for r in N.distance_fields(spark.createDataFrame(points, "k string, y int, x int"), 3, ["k"]).collect()}
    assert len(field) == (3 + 7) * (7 + 7) + 49
    for (k, y, x), d in field.items():
        assert d == pytest.approx(min(math.hypot(y - v, x - u) for n, v, u in points if n == k))


def pearson(pairs):
    n = len(pairs)
    ma, mb = sum(a for a, _ in pairs) / n, sum(b for _, b in pairs) / n
    den = math.sqrt(sum((a - ma) ** 2 for a, _ in pairs) * sum((b - mb) ** 2 for _, b in pairs))
    return sum((a - ma) * (b - mb) for a, b in pairs) / den if den else None


def costes(pairs):
    """A plain scan down the line."""
    n, sa, sb = len(pairs), sum(a for a, _ in pairs), sum(b for _, b in pairs)
    saa, sab = sum(a * a for a, _ in pairs), sum(a * b for a, b in pairs)
    slope, intercept = (n * sab - sa * sb) / (n * saa - sa * sa), (saa * sb - sa * sab) / (n * saa - sa * sa)
    top, low = max(a for a, _ in pairs), 1.0
    found = top, max(b for _, b in pairs)
    if slope <= 0:
        return found
    hi = int(min(top, (max(b for _, b in pairs) - intercept) / slope))
    for i in range(hi, int(max(min(a for a, _ in pairs), (min(b for _, b in pairs) - intercept) / slope)) - 1, -1):
        below = [(a, b) for a, b in pairs if a < i and b < int(slope * i + intercept)]
        r = pearson(below) if below else None
        if r is None:
            continue
        r = round(r, 12)
        if r <= low and i != hi:
            found = i, int(slope * i + intercept)
        low = min(low, r)
    return found


def test_costes_threshold_is_a_plain_scans(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        for _ in range(rng.choice([6, 40, 150])):
            a = rng.randrange(60)
            rows.append((k, a, max(0, int((0.2 * k) * a * (a > 25) + rng.gauss(12, 4)))))
    got = {r.k: (r.threshold_a, r.threshold_b) for r in M.costes_threshold(spark.createDataFrame([*rows, (0, None, 3), (99, 5, 5)], "k int, a int, b int"), ["k"], "a", "b").collect()}
    assert got.pop(99) == (5, 5)
    assert got == {k: costes([(a, b) for n, a, b in rows if n == k]) for k in range(12)}
    assert len(set(got.values())) > 6


def test_costes_randomised_repeats_and_moves_blocks(spark):
    rng = random.Random(6)
    image = [("a", y, x, rng.random(), 0.0) for y in range(9) for x in range(12)]
    image = [(k, y, x, v, v + rng.random() / 9) for k, y, x, v, _ in image]
    df = spark.createDataFrame(image, "k string, y int, x int, a double, b double")
    one = M.costes_randomised(df, ["k"], "a", "b", 12, 9, 3, 50).collect()
    again = M.costes_randomised(df.repartition(5), ["k"], "a", "b", 12, 9, 3, 50).collect()
    assert tuple(again[0])[1:] == pytest.approx(tuple(one[0])[1:], abs=1e-12)  # the same shifts, summed up in another order
    assert one[0].pearson > 0.9 and abs(one[0]["mean"]) < 0.3 and one[0].below > 0.9
    whole = M.costes_randomised(df.filter("x < 9"), ["k"], "a", "b", 9, 9, 9, 5).collect()[0]  # one block, which can't move
    assert whole["mean"] == pytest.approx(whole.pearson) and whole.sd == pytest.approx(0)
    assert M.costes_randomised(df.filter("false"), ["k"], "a", "b", 9, 9, 3, 5).count() == 0
    with pytest.raises(ValueError):
        M.costes_randomised(df, ["k"], "a", "b", 12, 9, 10, 5)

"""Scalers in two steps and thresholds that need a whole histogram, against plain scans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumentrack.operators import automatic as U
from lumentrack.operators import histograms as H
from lumentrack.operators import scalers as C

BINS = 64


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(4)
    out = {"one": {7: 5}, "two": {0: 1, 63: 3}, "even": {b: 2 for b in range(10)}}
    for k in range(6):
        low, high = rng.randrange(8, 20), rng.randrange(35, 55)
        values = [min(63, max(0, round(rng.gauss(low, 4) if rng.random() < 0.6 else rng.gauss(high, 5)))) for _ in range(400)]
        out[f"g{k}"] = {b: values.count(b) for b in set(values)}
    return out


@pytest.fixture(scope="module")
def hist(spark, groups):
    rows = [(g, b, n, 10.0, 0.5) for g, h in groups.items() for b, n in h.items()]
    return spark.createDataFrame(rows, "g string, bin int, count long, min double, bin_size double").cache()


def got(hist, method):
    return {r.g: r.threshold_bin for r in U.automatic(hist, ["g"], method, BINS).collect()}


def data(h):
    return [h.get(b, 0) for b in range(BINS)]


def huang(h):
    d = data(h)
    used = [b for b in range(BINS) if d[b]]
    first, last = used[0], used[-1]
    if first == last:
        return first

    def unsure(i, mean):
        u = 1 / (1 + abs(i - mean) / (last - first))
        return -u * math.log(u) - (1 - u) * math.log(1 - u) if u < 1 else 0

    scores = {}
    for t in range(first, last):
        total = 0
        for part in (range(first, t + 1), range(t + 1, last + 1)):
            mean = math.floor(sum(i * d[i] for i in part) / sum(d[i] for i in part) + 0.5)
            total += sum(d[i] * unsure(i, mean) for i in part)
        scores[t] = round(total, 6)
    return min(scores, key=lambda t: (scores[t], t))


def shanbhag(h):
    n = sum(h.values())
    p = [c / n for c in data(h)]
    c = [sum(p[: i + 1]) for i in range(BINS)]
    scores = {}
    for t in range(BINS):
        if c[t] > 1e-12 and 1 - c[t] > 1e-12:
            back = 0.5 / c[t] * sum(-p[i] * math.log(1 - 0.5 / c[t] * c[i - 1]) for i in range(1, t + 1))
            front = 0.5 / (1 - c[t]) * sum(-p[i] * math.log(1 - 0.5 / (1 - c[t]) * max(0, 1 - c[i])) for i in range(t + 1, BINS))
            scores[t] = round(abs(back - front), 6)
    return min(scores, key=lambda t: (scores[t], t)) if scores else None


def peaks(d):
    return [i for i in range(1, len(d) - 1) if d[i - 1] < d[i] > d[i + 1]]


def two_peaks(d):
    for _ in range(2000):
        if len(peaks(d)) == 2:
            return d
        d = [((d[i - 1] if i else 0.0) + d[i] + (d[i + 1] if i + 1 < len(d) else 0.0)) / 3 for i in range(len(d))]
    return None


def test_fuzziness_and_information(hist, groups):
    assert got(hist, "Huang") == {g: huang(h) for g, h in groups.items()}
    assert got(hist, "Shanbhag") == {g: shanbhag(h) for g, h in groups.items()}


def test_two_modes(hist, groups):
    between, valley = {}, {}
    for g, h in groups.items():
        low = min(h)
        d = two_peaks([float(c) for c in data(h)[low : max(h) + 1]])
        between[g] = d and low + sum(peaks(d)) // 2
        d = two_peaks([float(c) for c in data(h)])
        valley[g] = d and next((i for i in range(1, BINS - 1) if d[i - 1] > d[i] <= d[i + 1]), None)
    assert got(hist, "Intermodes") == between and got(hist, "Minimum") == valley
    assert sum(t is not None for t in between.values()) >= 6 and between["one"] is None


def test_least_error_is_where_both_fits_are_alike(hist, groups):
    found = got(hist, "MinError")
    assert found["one"] == 7 and found["two"] in range(64)
    for g in (g for g in groups if g.startswith("g")):
        h, t = groups[g], found[g]
        assert 15 < t < 50
        low, high = {b: c for b, c in h.items() if b <= t}, {b: c for b, c in h.items() if b > t}

        def likely(x, part, h=h):
            n = sum(part.values())
            mean = sum(b * c for b, c in part.items()) / n
            var = sum((b - mean) ** 2 * c for b, c in part.items()) / n
            return -((x - mean) ** 2) / var - math.log10(var) + 2 * math.log10(n / sum(h.values()))

        # The sign of the difference changes within a bin of the threshold.
        assert (likely(t, low) - likely(t, high)) * (likely(t + 1, low) - likely(t + 1, high)) <= 0


def kappa(h, k, k_final, rounds, symmetric):
    d, t, low = data(h), float(BINS - 1), 0.0
    for i in range(rounds):
        rows = [(b + 0.245, d[b]) for b in range(BINS) if b < t and b >= math.ceil(low)]
        at = max(0, int(t))
        last = d[0] if t <= 0 else d[-1] if t >= BINS - 1 else d[at] + (d[at + 1] - d[at]) * (t - at)
        rows.append((at + 0.245, last))
        n = sum(c for _, c in rows)
        mean = sum(x * c for x, c in rows) / n if n else 0
        sigma = math.sqrt(sum((x - mean) ** 2 * c for x, c in rows) / n) if n else 0
        f = k_final if i == rounds - 1 else k
        new = min(BINS - 1, mean + f * sigma)
        if abs(new - t) < 1e-8:
            break
        t = new
        if symmetric:
            low = mean - f * sigma
    return 10 + 0.5 * t


@pytest.mark.parametrize("symmetric", [False, True])
def test_kappa_sigma_of_bins(hist, groups, symmetric):
    rows = U.kappa_sigma_of_bins(hist, ["g"], 1.5, 1.0, 4, BINS, symmetric).collect()
    assert {r.g: round(r.threshold, 5) for r in rows} == {g: round(kappa(h, 1.5, 1.0, 4, symmetric), 5) for g, h in groups.items()}


def test_no_groups_and_bins_outside(hist):
    none = hist.filter("false")
    for m in U.METHODS:
        assert U.automatic(none, ["g"], m, BINS).count() == 0
    assert U.kappa_sigma_of_bins(none, ["g"], 1, 1, 2, BINS).count() == 0
    with pytest.raises(Exception, match="outside"):
        U.automatic(hist, ["g"], "Huang", 10).collect()


def test_mode_without_the_tails(spark):
    hist = spark.createDataFrame([("a", 0, 9, 0.0, 2.0), ("a", 3, 5, 0.0, 2.0), ("a", 4, 5, 0.0, 2.0), ("a", 7, 8, 0.0, 2.0), ("b", 0, 4, 1.0, 0.0)], "g string, bin int, count long, min double, bin_size double")
    at = lambda *skip: {r.g: r.centre for r in C.mode_values(hist, ["g"], 8, *skip).collect()}
    assert at() == {"a": 0.0, "b": 1.0} and at(1) == {"a": 14.0, "b": None} and at(1, 1) == {"a": 6.0, "b": None} and at(-3, -3) == at()
    fits = {r.g: (r.centre, r.scale) for r in C.mode_percentile(hist, ["g"], 0.5, 8, 1, 0).collect()}
    assert fits["a"] == (14.0, None) and fits["b"] == (None, None)  # the median isn't above the mode


def test_fits_are_applied_and_undone(spark):
    px = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 8.0), ("b", 5.0), ("c", 1.0), ("a", None)], "g string, value double")
    fits = spark.createDataFrame([("a", 0.0, 2.0), ("b", 5.0, 0.0)], "g string, centre double, scale double")
    run = lambda **o: sorted((r.g, r.value, r.scaled) for r in C.applied(px, fits, ["g"], **o).filter("value is not null").collect())
    assert run() == [("a", 0.0, 0.0), ("a", 4.0, 2.0), ("a", 8.0, 4.0), ("b", 5.0, None), ("c", 1.0, None)]
    assert [s for *_, s in run(power=0.5)][:3] == [0.0, math.sqrt(2), 2.0] and [s for *_, s in run(power=0)][:3] == [0.0, 1.0, 1.0]
    back = C.restored(C.applied(px, fits, ["g"]), fits, ["g"], name="back").filter("g = 'a'").collect()
    assert all(r.back == r.value for r in back) and len(back) == 4
    assert C.applied(px.filter("false"), fits, ["g"]).count() == 0


def test_saturation_presses_or_cuts(spark):
    px = spark.createDataFrame([("a", 1.0), ("a", 6.0), ("a", 10.0), ("b", 3.0), ("c", 9.0)], "g string, value double")
    limits = spark.createDataFrame([("a", 2.0, 4.0), ("b", 2.0, 4.0)], "g string, threshold double, most double")
    run = lambda lim: sorted((r.g, r.value) for r in C.saturated(px, lim, ["g"]).collect())
    assert run(limits) == [("a", 1.0), ("a", 3.0), ("a", 4.0), ("b", 3.0), ("c", 9.0)]
    assert run(limits.withColumn("most", F.col("threshold"))) == [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("c", 9.0)]
    with pytest.raises(Exception, match="below the threshold"):
        run(limits.withColumn("most", F.lit(1.0)))


def test_own_range_of_equal_values(spark):
    px = spark.createDataFrame([("a", 2.0)] * 3, "g string, value double")
    assert [(r.bin, r["count"]) for r in H.grouped_bins(px, ["g"], 8).collect()] == [(0, 3)]

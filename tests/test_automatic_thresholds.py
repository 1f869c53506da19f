"""Automatic thresholds of histograms against plain scans over all bins."""

import math
import random

import pytest

from lumentrack.operators import histograms as H


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(9)
    out = {"one": {7: 5}, "two": {0: 1, 255: 3}, "even": {b: 2 for b in range(10)}}
    for k in range(8):
        low, high = rng.randrange(10, 90), rng.randrange(110, 240)
        values = [min(255, max(0, round(rng.gauss(low, 12) if rng.random() < 0.6 else rng.gauss(high, 9)))) for _ in range(400)]
        out[f"g{k}"] = {b: values.count(b) for b in set(values)}
    return out


@pytest.fixture(scope="module")
def hist(spark, groups):
    return spark.createDataFrame([(g, b, n) for g, h in groups.items() for b, n in h.items()], "g string, bin int, count long").cache()


def got(df):
    return {r.g: r.threshold_bin for r in df.collect()}


def scan(h, score):
    """The lowest bin of the highest score over two classes that both have pixels."""
    n = sum(h.values())
    best = None
    for t in sorted(h)[:-1]:
        low, high = ([c / n for b, c in h.items() if (b <= t) == side] for side in (True, False))
        s = round(score(low, high), 6)
        if best is None or s > best[0]:
            best = s, t
    return best and best[1]


def rooted(low, high):
    return 2 * math.log(math.prod(sum(math.sqrt(p / sum(c)) for p in c) for c in (low, high)))


def plain(low, high):
    return sum(-sum(p / sum(c) * math.log(p / sum(c)) for p in c) for c in (low, high))


def squared(low, high):
    return -math.log(math.prod(sum((p / sum(c)) ** 2 for p in c) for c in (low, high)))


def yen(low, high):
    return 2 * math.log(sum(low) * sum(high)) - math.log(sum(p * p for p in low) * sum(p * p for p in high))


def test_yen(hist, groups):
    want = {g: scan(h, yen) for g, h in groups.items()}
    assert got(H.yen(hist, ["g"])) == {g: t for g, t in want.items() if t is not None}


def test_renyi_entropy(hist, groups):
    want = {}
    for g, h in groups.items():
        t = [scan(h, f) for f in (rooted, plain, squared)]
        if None in t:
            continue
        t.sort()
        up_to = [sum(c for b, c in h.items() if b <= x) / sum(h.values()) for x in t]
        low, high = t[1] - t[0] <= 5, t[2] - t[1] <= 5
        w = (0, 1, 3) if low and not high else (3, 1, 0) if high and not low else (1, 2, 1)
        omega = up_to[2] - up_to[0]
        want[g] = math.floor(round(t[0] * (up_to[0] + omega * w[0] / 4) + t[1] * omega * w[1] / 4 + t[2] * (1 - up_to[2] + omega * w[2] / 4), 6))
    assert got(H.renyi_entropy(hist, ["g"])) == want and len(want) == len(groups) - 1


def test_moments_keep_the_first_three(hist, groups):
    found = got(H.moments(hist, ["g"]))
    assert found.pop("one") is None and found.pop("two") == 255  # 0 has just the share, and not more
    for g, t in found.items():
        h, n = groups[g], sum(groups[g].values())
        m = [sum(c * b**k for b, c in h.items()) / n for k in range(4)]
        # Levels a < b and the share p of the lower one with p a^k + (1 - p) b^k = m[k] for k up to 3.
        spread = m[2] - m[1] ** 2
        total, product = (m[3] - m[1] * m[2]) / spread, (m[1] * m[3] - m[2] ** 2) / spread
        a, b = (total - math.sqrt(total**2 - 4 * product)) / 2, (total + math.sqrt(total**2 - 4 * product)) / 2
        p = (b - m[1]) / (b - a)
        assert [p * a**k + (1 - p) * b**k for k in range(4)] == pytest.approx(m, rel=1e-6)
        up_to = lambda x: sum(c for v, c in h.items() if v <= x) / n  # noqa: B023, E731
        assert up_to(t) > p - 1e-9 and up_to(t - 1) <= p + 1e-9


def test_mean_and_half(hist, groups):
    assert got(H.mean_level(hist, ["g"])) == {g: sum(b * c for b, c in h.items()) // sum(h.values()) for g, h in groups.items()}
    half = {g: min(h, key=lambda t: (round(abs(sum(c for b, c in h.items() if b <= t) / sum(h.values()) - 0.5), 9), t)) for g, h in groups.items()}  # noqa: B023
    assert got(H.half_level(hist, ["g"])) == half


def test_li_by_repetition(hist, groups):
    want = {}
    for g, h in groups.items():
        level = sum(b * c for b, c in h.items()) / sum(h.values())
        while True:
            t = math.floor(level + 0.5)
            mean = [sum(b * c for b, c in h.items() if (b <= t) == s) / max(1, sum(c for b, c in h.items() if (b <= t) == s)) for s in (True, False)]
            new = math.floor(round((mean[0] - mean[1]) / (math.log(mean[0]) - math.log(mean[1])), 9) + 0.5) if min(mean) > 0 else 0
            if abs(new - level) <= 0.5:
                break
            level = new
        want[g] = t
    assert got(H.li(hist, ["g"])) == want
    with pytest.raises(RuntimeError):
        H.li(hist, ["g"], most=1)


def test_no_groups(hist):
    for f in (H.yen, H.renyi_entropy, H.moments, H.mean_level, H.half_level, H.li):
        assert f(hist.filter("false"), ["g"]).count() == 0

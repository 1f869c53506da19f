"""Histograms, scalers and thresholds: two-phase aggregates per group, joined back where rows need them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.functions.forests import spanning_forest
from lumentrack.session import cut, written


def fixed_bins(df: DataFrame, keys: Sequence[str], low: float, size: float, n: int, value: str = "value") -> DataFrame:
    """HI-1: counts by bin; the upper edge falls in the last bin, values outside nowhere."""
    v = F.col(value)
    b = F.least(F.floor((v - low) / size), F.lit(n - 1)).cast("int")
    return df.filter((v >= low) & (v <= low + size * n)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def bin_widths(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """HI-2: minimum, maximum, bin width by Scott and by Freedman and Diaconis (Scott where the quartiles meet), and the number of bins, 32 to 65,535."""
    v = F.col(value)
    stats = df.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("_s"), F.count(v).alias("n"))
    stats = stats.join(percentile_columns(df, keys, {"_q1": 0.25, "_q3": 0.75}, value), list(keys), "left")
    root = F.pow("n", F.lit(-1.0 / 3))
    scott, iqr = 3.49 * F.col("_s") * root, F.col("_q3") - F.col("_q1")
    out = stats.withColumn("scott", scott).withColumn("freedman", F.when(iqr > 0, 2 * iqr * root).otherwise(scott))
    bins = F.least(F.greatest(F.ceil((F.col("max") - F.col("min")) / F.nullif(F.col("freedman"), F.lit(0.0))), F.lit(32)), F.lit(65535))
    return out.withColumn("n_bins", bins.cast("long")).drop("_s", "_q1", "_q3")


def grouped_bins(df: DataFrame, keys: Sequence[str], n: int = 256, value: str = "value") -> DataFrame:
    """HI-8: each group's histogram of ``n`` bins from its minimum to its maximum, with ``min`` and ``bin_size``; values that are all equal are in the first."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("min"), ((F.max(value) - F.min(value)) / n).alias("bin_size"))
    b = F.when(F.col("bin_size") > 0, F.least(F.floor((F.col(value) - F.col("min")) / F.nullif(F.col("bin_size"), F.lit(0.0))), F.lit(n - 1))).otherwise(0).cast("int")
    return df.join(limits, list(keys)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("min").alias("min"), F.first("bin_size").alias("bin_size"))


def merged(*hists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HI-5."""
    out = hists[0]
    for h in hists[1:]:
        out = out.unionByName(h)
    return out.groupBy(*keys, "bin").agg(F.sum("count").alias("count"))


def quantile(hist: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """HI-3, HI-4: quantile of a histogram (min and bin_size beside the counts), linear within the bin that it falls in, counted from the top."""
    down = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.partitionBy(*keys))
    rows = hist.withColumn("_above", F.sum("count").over(down)).withColumn("_want", total * (1 - q))
    rows = rows.filter((F.col("_above") >= F.col("_want")) & (F.col("_above") - F.col("count") < F.col("_want")) | (F.col("_want") <= 0) & (F.col("_above") == F.col("count")))
    inside = (F.col("_above") - F.col("_want")) / F.col("count")
    found = F.col("min") + F.col("bin_size") * (F.col("bin") + inside)
    return rows.groupBy(*keys).agg(F.max(found).alias("quantile"))


def mode(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HI-6: the fullest bin (the lowest of equals), the mean bin, and the count."""
    b = F.max_by("bin", F.struct("count", -F.col("bin")))
    return hist.groupBy(*keys).agg(b.alias("mode"), (F.sum(F.col("bin") * F.col("count")) / F.sum("count")).alias("mean_bin"), F.sum("count").alias("total"))


def trimmed(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HI-6: less the empty bins before the first and after the last that has pixels; a group without pixels goes."""
    used = hist.filter("count > 0").groupBy(*keys).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    return hist.join(used, list(keys)).filter("bin between _lo and _hi").drop("_lo", "_hi")


def erased(hist: DataFrame, first: int, end: int) -> DataFrame:
    """HI-6: no pixels in the bins from ``first`` up to before ``end``."""
    return hist.withColumn("count", F.when((F.col("bin") >= first) & (F.col("bin") < end), 0).otherwise(F.col("count")).cast("long"))


def interpolated_counts(hist: DataFrame, places: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """HI-6: ``places`` (keys, at) with the count at each place between bins, linear; that of the first or last of ``bins`` beyond them. Bins without a row are empty."""
    low = F.least(F.greatest(F.floor("at"), F.lit(0)), F.lit(bins - 1)).cast("int")
    part = F.when((F.col("at") <= 0) | (F.col("at") >= bins - 1), 0.0).otherwise(F.col("at") - F.floor("at"))
    rows = places.withColumns({"bin": low, "_p": part})
    at = lambda name, c: hist.select(*keys, (F.col("bin") - c).alias("bin"), F.col("count").alias(name))
    rows = rows.join(at("_n0", 0), [*keys, "bin"], "left").join(at("_n1", 1), [*keys, "bin"], "left")
    n0, n1 = (F.coalesce(c, F.lit(0)) for c in ("_n0", "_n1"))
    return rows.withColumn("count", n0 + (n1 - n0) * F.col("_p")).drop("bin", "_p", "_n0", "_n1")


def unsaturated(hist: DataFrame, keys: Sequence[str], factor: float, low: bool = False) -> DataFrame:
    """HI-7: less the last bin (or with ``low`` the first) where it is ``factor`` times fuller than the one next to it."""
    w = Window.partitionBy(*keys).orderBy(F.desc("bin") if low else "bin")
    last = F.lead("bin").over(w).isNull()
    return hist.withColumn("_d", last & (F.col("count") > F.coalesce(F.lag("count").over(w), F.lit(0)) * factor)).filter(~F.col("_d")).drop("_d")


def local_maxima(hist: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """HI-9: bins at least as full as those within ``half`` rows."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    return hist.withColumn("_m", F.max("count").over(w)).filter(F.col("count") == F.col("_m")).drop("_m")


# --- scalers ---


def scaled(df: DataFrame, keys: Sequence[str], centre: Column, scale: Column, value: str = "value") -> DataFrame:
    """SC-1 to SC-7: (value - centre) / scale, both aggregates of the group; null where the scale is 0."""
    stats = df.groupBy(*keys).agg(centre.alias("_c"), scale.alias("_s"))
    return df.join(stats, list(keys)).withColumn("scaled", (F.col(value) - F.col("_c")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_c", "_s")


def z_score(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """SC-3."""
    return scaled(df, keys, F.avg(value), F.stddev_pop(value), value)


def min_max(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """SC-4, PX-8."""
    return scaled(df, keys, F.min(value), F.max(value) - F.min(value), value)


def _scaled_between(df: DataFrame, keys: Sequence[str], centre: float, low: float, high: float, value: str) -> DataFrame:
    p = percentile_columns(df, keys, {"_c": centre, "_lo": low, "_hi": high}, value)
    return df.join(p, list(keys), "left").withColumn("scaled", (F.col(value) - F.col("_c")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_c", "_lo", "_hi")


def iqr(df: DataFrame, keys: Sequence[str], low: float = 0.25, high: float = 0.75, value: str = "value") -> DataFrame:
    """SC-2."""
    return _scaled_between(df, keys, 0.5, low, high, value)


def percentile_range(df: DataFrame, keys: Sequence[str], low: float, high: float, power: float | None = None, value: str = "value") -> DataFrame:
    """SC-6, SC-9: between two quantiles to 0 and 1; beyond them cut off, or with ``power`` bent."""
    out = _scaled_between(df, keys, low, low, high, value)
    s = F.col("scaled")
    if power is None:
        return out.withColumn("scaled", F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))))
    return out.withColumn("scaled", F.when(s > 1, F.pow(s, F.lit(power))).when(s < 0, -F.pow(-s, F.lit(power))).otherwise(s))


def relative(df: DataFrame, keys: Sequence[str], centre: Column, value: str = "value") -> DataFrame:
    """SC-7: value over the group's centre."""
    return scaled(df, keys, F.lit(0.0) * F.count(F.lit(1)), centre, value)


def relative_to_percentile(df: DataFrame, keys: Sequence[str], q: float, value: str = "value") -> DataFrame:
    """SC-7: value over the group's quantile; null where that is 0."""
    p = percentile_columns(df, keys, {"_c": q}, value)
    return df.join(p, list(keys), "left").withColumn("scaled", F.col(value) / F.nullif(F.col("_c"), F.lit(0.0))).drop("_c")


def unscaled(value: Column, centre: Column, scale: Column) -> Column:
    """SC-8."""
    return value * scale + centre


# --- thresholds ---


def kappa_sigma(df: DataFrame, keys: Sequence[str], k: float, k_final: float, rounds: int, value: str = "value") -> DataFrame:
    """TH-2: mean + k sigma of the values below the last threshold, ``rounds`` times; the last takes ``k_final``. Only thresholds are kept between rounds."""
    limits = df.select(*keys).distinct().withColumn("threshold", F.lit(float("inf")))
    for i in range(rounds):
        factor = k_final if i == rounds - 1 else k
        below = df.join(limits, list(keys)).filter(F.col(value) < F.col("threshold"))
        limits = below.groupBy(*keys).agg((F.avg(value) + factor * F.stddev_pop(value)).alias("threshold"))
    return limits


def otsu(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the bin (the lowest of equals) after which the two classes' means differ most, weighed by their sizes."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    m = F.col("bin").cast("double") * F.col("count")
    rows = hist.select(*keys, "bin", F.sum("count").over(w).cast("double").alias("n0"), F.sum(m).over(w).alias("m0"), F.sum("count").over(whole).cast("double").alias("n"), F.sum(m).over(whole).alias("m"))
    rows = rows.filter("n0 < n")
    between = F.pow(F.col("m0") / F.col("n0") - (F.col("m") - F.col("m0")) / (F.col("n") - F.col("n0")), F.lit(2)) * F.col("n0") * (F.col("n") - F.col("n0")) / F.pow("n", F.lit(2))
    rows = rows.withColumn("between", F.round(between, 6))
    return rows.groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold_bin"), F.max("between").alias("between"))


def max_entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the bin after which the entropies of the two classes add up to most."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("count") / F.sum("count").over(whole)
    rows = hist.filter("count > 0").withColumn("p", p).withColumn("q", p * F.log(p))
    rows = rows.select(*keys, "bin", F.sum("p").over(w).alias("p0"), F.sum("q").over(w).alias("q0"), F.sum("q").over(whole).alias("q"), F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin")).alias("after"))
    rows = rows.filter("after is not null")
    entropy = F.log("p0") - F.col("q0") / F.col("p0") + F.log(1 - F.col("p0")) - (F.col("q") - F.col("q0")) / (1 - F.col("p0"))
    rows = rows.withColumn("entropy", F.round(entropy, 6))
    return rows.groupBy(*keys).agg(F.max_by("bin", F.struct("entropy", -F.col("bin"))).alias("threshold_bin"), F.max("entropy").alias("entropy"))


def triangle(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the bin above the mode furthest below the line from the mode's count to the last bin."""
    top = mode(hist, keys).join(hist.groupBy(*keys).agg(F.max("bin").alias("last"), F.max("count").alias("peak")), list(keys))
    rows = hist.join(top, list(keys)).filter(F.col("bin") >= F.col("mode"))
    line = F.col("peak") * (F.col("last") - F.col("bin")) / F.nullif(F.col("last") - F.col("mode"), F.lit(0))
    rows = rows.withColumn("below", F.round(line - F.col("count"), 6))
    return rows.groupBy(*keys).agg(F.max_by("bin", F.struct("below", -F.col("bin"))).alias("threshold_bin"))


def _classes(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of each bin that has pixels: ``p`` its own, ``p0`` up to it, and for later use the sums up to it and in all of p's root and square."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.filter("count > 0").select(*keys, "bin", (F.col("count") / F.sum("count").over(whole)).alias("p"), (F.sum("count").over(w) / F.sum("count").over(whole)).alias("p0"))
    parts = {"r": F.sqrt("p"), "s": F.col("p") * F.col("p"), "e": F.col("p") * F.log("p")}
    return rows.withColumns({f"{c}{n}": F.sum(e).over(o) for c, e in parts.items() for n, o in (("0", w), ("", whole))})


def _best(rows: DataFrame, keys: Sequence[str], score: Column, name: str = "threshold_bin") -> DataFrame:
    """The lowest of the bins of the highest score, of those below the last one, to 6 digits."""
    rows = rows.filter("p0 < 1").withColumn("_score", F.round(score, 6)).filter("_score is not null")
    return rows.groupBy(*keys).agg(F.max_by("bin", F.struct("_score", -F.col("bin"))).alias(name))


def yen(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the bin after which the two classes' correlation is highest: twice the log of the product of their shares, less that of their sums of squared shares. A group of one bin has no row."""
    return _best(_classes(hist, keys), keys, 2 * F.log(F.col("p0") * (1 - F.col("p0"))) - F.log(F.col("s0") * (F.col("s") - F.col("s0"))))


def mean_level(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the bin of the mean."""
    return hist.groupBy(*keys).agg(F.floor(F.sum(F.col("bin") * F.col("count")) / F.nullif(F.sum("count"), F.lit(0))).alias("threshold_bin"))


def half_level(hist: DataFrame, keys: Sequence[str], share: float = 0.5) -> DataFrame:
    """TH-5: the bin up to which there is as near as can be to ``share`` of the pixels, the lowest of equals."""
    return _classes(hist, keys).withColumn("_far", F.round(F.abs(F.col("p0") - share), 9)).groupBy(*keys).agg(F.min_by("bin", F.struct("_far", "bin")).alias("threshold_bin"))


def moments(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: the first bin up to which there is more than the share that the lower of two levels must have, if these two are to keep the first three moments. Null where all pixels are in one bin."""
    m = [F.sum(F.pow(F.col("bin").cast("double"), F.lit(k)) * F.col("p")) for k in (1, 2, 3)]
    rows = _classes(hist, keys)
    found = rows.groupBy(*keys).agg(*[F.round(e, 12).alias(f"_m{k}") for k, e in enumerate(m, 1)])
    m1, m2, m3 = F.col("_m1"), F.col("_m2"), F.col("_m3")
    spread = F.nullif(F.round(m2 - m1 * m1, 9), F.lit(0.0))
    found = found.withColumns({"_c0": (m1 * m3 - m2 * m2) / spread, "_c1": (m1 * m2 - m3) / spread})
    root = F.sqrt(F.greatest(F.col("_c1") * F.col("_c1") - 4 * F.col("_c0"), F.lit(0.0)))
    found = found.withColumns({"_z0": (-F.col("_c1") - root) / 2, "_z1": (-F.col("_c1") + root) / 2})
    found = found.select(*keys, F.round((F.col("_z1") - m1) / F.nullif(F.col("_z1") - F.col("_z0"), F.lit(0.0)), 9).alias("_share"))
    return rows.join(found, list(keys)).groupBy(*keys).agg(F.min(F.when(F.round("p0", 9) > F.col("_share"), F.col("bin"))).alias("threshold_bin"))


def renyi_entropy(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TH-5: a mean of the bins after which the Rényi entropies of order 1/2, 1 and 2 of both classes add up to most, weighed by the pixels between them.

    Bins within 5 of each other share the middle's weight: 1, 2, 1 where both gaps or neither are that small, else 3 for
    the one apart (as 0, 1, 3 or 3, 1, 0). A group of one bin has no row.
    """
    rows = written(_classes(hist, keys))
    p0, p1 = F.col("p0"), 1 - F.col("p0")
    scores = {
        "_half": 2 * F.log(F.col("r0") * (F.col("r") - F.col("r0")) / F.sqrt(p0 * p1)),
        "_one": F.log(p0 * p1) - F.col("e0") / p0 - (F.col("e") - F.col("e0")) / p1,
        "_two": -F.log(F.col("s0") / (p0 * p0) * (F.col("s") - F.col("s0")) / (p1 * p1)),
    }
    best = [_best(rows, keys, e, name) for name, e in scores.items()]
    three = best[0].join(best[1], list(keys)).join(best[2], list(keys)).withColumn("_t", F.array_sort(F.array(*scores)))
    low, high = (F.col("_t")[1] - F.col("_t")[0]) <= 5, (F.col("_t")[2] - F.col("_t")[1]) <= 5
    weights = lambda *n: F.array(*[F.lit(k / 4) for k in n])
    three = three.select(*keys, "_t", F.when(low & ~high, weights(0, 1, 3)).when(~low & high, weights(3, 1, 0)).otherwise(weights(1, 2, 1)).alias("_w"))
    shares = rows.join(three, list(keys)).groupBy(*keys, "_t", "_w").agg(*[F.max(F.when(F.col("bin") == F.col("_t")[k], F.col("p0"))).alias(f"_p{k}") for k in (0, 2)])
    t, w, between = (lambda k: F.col("_t")[k]), (lambda k: F.col("_w")[k]), F.col("_p2") - F.col("_p0")
    level = t(0) * (F.col("_p0") + between * w(0)) + t(1) * between * w(1) + t(2) * (1 - F.col("_p2") + between * w(2))
    return shares.select(*keys, F.floor(F.round(level, 6)).alias("threshold_bin"))


def li(hist: DataFrame, keys: Sequence[str], most: int = 1000) -> DataFrame:
    """TH-5: the level of least cross entropy between the image and its two classes' means, found by repetition from the mean of all.

    Each round goes to (m0 - m1) / (ln m0 - ln m1) of the means up to the level and above, rounded, and a group ends where that moves by
    half a bin at most; bins count from 0 on. Raises if a group moves on after ``most`` rounds.
    """
    hist = written(hist.filter("count > 0").select(*keys, "bin", "count"))
    moving = written(hist.groupBy(*keys).agg((F.sum(F.col("bin") * F.col("count")) / F.sum("count")).alias("level")))
    done = moving.select(*keys, F.lit(0).cast("long").alias("threshold_bin")).limit(0)
    for _ in range(most):
        at = F.floor(F.col("level") + 0.5)
        m = F.col("bin") * F.col("count")
        mean = lambda c: F.coalesce(F.sum(F.when(c, m)) / F.sum(F.when(c, F.col("count"))), F.lit(0.0))
        sides = hist.join(moving, list(keys)).groupBy(*keys, "level").agg(mean(F.col("bin") <= at).alias("_m0"), mean(F.col("bin") > at).alias("_m1"))
        # The log of a mean of 0 has no bound, which makes the next level 0.
        level = F.when((F.col("_m0") > 0) & (F.col("_m1") > 0), (F.col("_m0") - F.col("_m1")) / (F.log("_m0") - F.log("_m1"))).otherwise(0.0)
        sides = written(sides.select(*keys, at.alias("threshold_bin"), "level", F.floor(F.round(level, 9) + 0.5).cast("double").alias("_new")))
        rests = F.abs(F.col("_new") - F.col("level")) <= 0.5
        done = done.unionByName(sides.filter(rests).select(*keys, "threshold_bin"))
        moving = sides.filter(~rests).select(*keys, F.col("_new").alias("level"))
        if moving.isEmpty():
            return done
    raise RuntimeError(f"no level after {most} rounds")


def isodata(hist: DataFrame, keys: Sequence[str], most: int = 100) -> DataFrame:
    """TH-5: the level midway between the means of the two sides, found by repetition (``most`` rounds at the longest)."""
    level = cut(hist.groupBy(*keys).agg((F.sum(F.col("bin") * F.col("count")) / F.sum("count")).alias("level")))
    for _ in range(most):
        both = hist.join(level, list(keys))
        low, m = F.col("bin") <= F.col("level"), F.col("bin") * F.col("count")
        mean = lambda c: F.sum(F.when(c, m)) / F.sum(F.when(c, F.col("count")))
        new = both.groupBy(*keys).agg(F.first("level").alias("_old"), ((mean(low) + F.coalesce(mean(~low), mean(low))) / 2).alias("level"))
        new = cut(new)
        level = new.drop("_old")
        if new.filter(F.abs(F.col("level") - F.col("_old")) > 1e-6).isEmpty():
            return level
    raise RuntimeError(f"no level after {most} rounds")


def background_fit(hist: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    """TH-4: mode and sigma of the lower half of its peak, from the log-parabola through the bins above a third of the peak; threshold = mode + k sigma, in bins."""
    top = hist.groupBy(*keys).agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("mu"), F.max("count").alias("peak"))
    low = hist.join(top, list(keys)).filter((F.col("bin") < F.col("mu")) & (F.col("count") * 3 >= F.col("peak")))
    d2 = F.pow(F.col("bin") - F.col("mu"), F.lit(2))
    fit = low.groupBy(*keys).agg((F.sum(d2 * d2) / F.nullif(-2 * F.sum(d2 * F.log(F.col("count") / F.col("peak"))), F.lit(0.0))).alias("_v"))
    return top.join(fit, list(keys), "left").select(*keys, "mu", F.sqrt("_v").alias("sigma"), (F.col("mu") + k * F.sqrt("_v")).alias("threshold"))


def filtered_statistic(df: DataFrame, limits: DataFrame, keys: Sequence[str], statistic: Column, over: bool = True, value: str = "value") -> DataFrame:
    """TH-7, TH-9: a statistic of the values over (or under) thresholds found for the same keys or for their ancestors."""
    return _beyond(df, limits, keys, over, value).groupBy(*keys).agg(statistic.alias("statistic"))


def _beyond(df: DataFrame, limits: DataFrame, keys: Sequence[str], over: bool, value: str) -> DataFrame:
    return df.join(limits, list(keys)).filter(F.col(value) > F.col("threshold") if over else F.col(value) < F.col("threshold"))


def filtered_percentile(df: DataFrame, limits: DataFrame, keys: Sequence[str], q: float, over: bool = True, value: str = "value") -> DataFrame:
    """TH-7: likewise the exact quantile of these values, with no group in one task."""
    found = exact_percentiles(written(_beyond(df, limits, keys, over, value).select(*keys, value)), keys, [q], value)
    return found.select(*keys, F.col("percentile").alias("statistic"))


# --- thresholds by number of objects, exact percentiles of any group ---


#: Side of the tiles of an image within which one task joins pixels.
TILE = 64


def forest_of_tiles(tile: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray, steps: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pixels of many tiles (numbered, ``y`` and ``x`` from 0 within each) that count, of repeated ones the brightest; and places of both ends of the joints of a maximum spanning forest of each tile, with their weights.

    In each round every component takes its heaviest joint, all tiles' at once; joints have one order, so no ring arises.
    """
    side = TILE + 2
    code = (tile * side + y + 1) * side + x + 1
    order = np.lexsort((value, code))
    order = order[np.concatenate([code[order][1:] != code[order][:-1], [True]])]
    code, v, a, b = code[order], value[order], [], []
    for dy, dx in steps:
        at = np.minimum(np.searchsorted(code, code + dy * side + dx), len(code) - 1)
        here = np.flatnonzero(code[at] == code + dy * side + dx)
        a.append(here)
        b.append(at[here])
    a, b = np.concatenate(a), np.concatenate(b)
    weight = (np.fmin if v.dtype.kind == "f" else np.minimum)(v[a], v[b])
    rising = np.argsort(weight, kind="stable")
    a, b, weight = a[rising], b[rising], weight[rising]
    of, chosen, left = np.arange(len(v)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        left = left[of[a[left]] != of[b[left]]]
        if not len(left):
            break
        best = np.full((2, len(v)), -1)
        best[0, of[a[left]]], best[1, of[b[left]]] = left, left  # the last one written, the heaviest, stays
        best = best.max(axis=0)
        has = np.flatnonzero(best >= 0)
        chosen[best[has]] = True
        up = np.arange(len(v))
        up[has] = of[a[best[has]]] + of[b[best[has]]] - has
        root = (up[up] == np.arange(len(v))) & (np.arange(len(v)) < up)
        up[root] = np.flatnonzero(root)
        while (up[up] != up).any():
            up = up[up]
        of = up[of]
    return order, order[a[chosen]], order[b[chosen]], weight[chosen]


def _by_tile(px: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], counted: bool) -> DataFrame:
    """Of pixels (keys, y, x, value) the forest's joints (keys, y0, x0, y, x, value) of each tile; or ``counted`` the number of ``objects`` in each at each value.

    Pixels are dealt by tile once; a task reads its tiles in order, some at a time.
    """
    corner = lambda c: (F.floor(F.col(c) / TILE) * TILE).alias(f"_{c}")
    tile = [*keys, "_y", "_x"]
    rows = px.select(*keys, corner("y"), corner("x"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "value").repartition(*tile).sortWithinPartitions(*tile)
    n = len(tile)

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        y0, x0, y, x, v = (batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(5))
        number = np.cumsum(np.bincount(starts, minlength=len(v))) - 1
        kept, a, b, weight = forest_of_tiles(number, y - y0, x - x0, v, steps)
        if not counted:
            ends = [pa.array(c) for c in (y[a], x[a], y[b], x[b], weight)]
            return pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(a)) for i in range(len(keys))], *ends], names=names)
        g, values = number[np.concatenate([kept, a])], np.concatenate([v[kept], weight])
        order = np.lexsort((values, -g))[::-1]
        g, values = g[order], values[order]
        total = np.cumsum(np.where(order < len(kept), 1, -1))
        total -= np.concatenate([[0], total])[np.searchsorted(g, g)]
        same = (g[1:] == g[:-1]) & ((values[1:] == values[:-1]) | (values[1:] != values[1:]) & (values[:-1] != values[:-1]))
        last = np.concatenate([~same, [True]])
        at = pa.array(starts[g[last]])
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.array(values[last]), pa.array(total[last])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            starts = _starts(whole := pa.Table.from_batches(held).combine_chunks().to_batches()[0], n) if sum(b.num_rows for b in held) else []
            if len(starts) > 1:  # the last tile may go on in the next batch
                yield work(whole.slice(0, starts[-1]), starts[:-1])
                held = [whole.slice(starts[-1])]
        if sum(b.num_rows for b in held):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield work(whole, _starts(whole, n))

    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = [*[(k, of[k]) for k in keys], *([("value", of["value"]), ("objects", "long")] if counted else [*[(c, "long") for c in ("y0", "x0", "y", "x")], ("value", of["value"])])]
    names = [c for c, _ in columns]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in columns))


def _starts(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Where another value of the first ``n`` columns begins than in the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for i in range(n):
        c = batch.column(i)
        a, b = c[:-1], c[1:]
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= other.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def object_counts(df: DataFrame, keys: Sequence[str] = ("frame",), low: bool = False) -> DataFrame:
    """TH-11: for every value of each image the number of ``objects`` among the pixels that are as bright or brighter, 8 or (``low``) 4 neighbours joined.

    All thresholds are answered at once: neighbours are joined from the darker one's value on, and of these joints only
    those of a maximum spanning forest lessen the number of objects, each by one. So an image has as many objects at a
    threshold as pixels less joints from there up. An image within one tile is settled where its pixels were dealt to; of
    larger ones each tile's forest, and what joins tiles, goes on to rounds over all images. Pixels without a value or place are left out.
    """
    steps = [(0, 1), (1, 0)] if low else [(0, 1), (1, 0), (1, 1), (1, -1)]
    by = list(keys) or ["_all"]
    px = df.filter("value is not null and y is not null and x is not null").withColumns({} if keys else {"_all": F.lit(0)}).select(*by, "y", "x", "value")
    tile = lambda c: F.floor(F.col(c) / TILE)
    limits = px.groupBy(*by).agg(*[f(tile(c)).alias(f"_{n}{c}") for c in "yx" for f, n in ((F.min, 0), (F.max, 1))])
    wide = written(limits.filter("_0y <> _1y or _0x <> _1x").select(*by))
    if wide.isEmpty():
        return _by_tile(px, by, steps, counted=True).select(*keys, "value", "objects")
    small = _by_tile(px.join(wide, by, "left_anti"), by, steps, counted=True)
    large = written(px.join(wide, by, "left_semi").groupBy(*by, "y", "x").agg(F.max("value").alias("value")))
    place = lambda y, x: F.struct(*by, y.cast("long").alias("y"), x.cast("long").alias("x"))
    edge = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    rim = large.filter(edge("y") | edge("x"))
    near = rim.select(*by, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("value").alias("v0"), F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("d"))
    near = near.select(*by, "y0", "x0", "v0", (F.col("y0") + F.col("d.dy")).alias("y"), (F.col("x0") + F.col("d.dx")).alias("x")).filter((tile("y0") != tile("y")) | (tile("x0") != tile("x")))
    across = near.join(rim, [*by, "y", "x"]).select(*by, "y0", "x0", "y", "x", F.least("v0", "value").alias("value"))
    edges = _by_tile(large, by, steps, counted=False).unionByName(across).select(place(F.col("y0"), F.col("x0")).alias("a"), place(F.col("y"), F.col("x")).alias("b"), F.col("value").alias("weight"))
    joints = spanning_forest(edges).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("weight").alias("value"), F.lit(-1).alias("_n"))
    steps_ = large.select(*by, "value", F.lit(1).alias("_n")).unionByName(joints).groupBy(*by, "value").agg(F.sum("_n").alias("_n"))
    counts = steps_.select(*by, "value", F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("value"))).alias("objects"))
    return small.unionByName(counts).select(*keys, "value", "objects")


def threshold_by_objects(df: DataFrame, most: int, keys: Sequence[str] = ("frame",), low: bool = False) -> DataFrame:
    """TH-11: the lowest value of each image from which on up no threshold gives more than ``most`` objects, with the number that it gives. Images whose brightest pixels are more already have none."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"))
    rows = object_counts(df, keys, low).withColumn("_worst", F.max("objects").over(w)).filter(F.col("_worst") <= most)
    return rows.groupBy(*keys).agg(F.min("value").alias("threshold"), F.min_by("objects", "value").alias("objects"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], qs: Sequence[float], value: str = "value", few: int = 4096, bins: int = 256) -> DataFrame:
    """HI-3: (keys, q, percentile) exactly, linear between ranks, however many rows a group has.

    Each rank asked for has a bracket of values. In each round the rows within a bracket are counted in ``bins`` equal
    parts with their least and greatest value, which map-side sums make small; the part with the rank becomes the
    bracket. At ``few`` rows, or one value, what is left is ranked. So no task has more than its share of a group. Null and
    NaN values are left out.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = whole.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_at", F.col("q") * (F.col("n") - 1))
    asked = written(asked.select(*by, "q", "_at", "lo", "hi", "n"))
    ranks = asked.select(*by, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("rank"), "lo", "hi", "n").distinct()
    # rank: how many values within the bracket are before; of: the rank in the group.
    open_, found = written(ranks.withColumn("of", F.col("rank"))), []
    while True:
        same = F.col("lo") == F.col("hi")
        found.append(open_.filter(same).select(*by, "of", F.col("lo").alias("v")))
        brackets = open_.filter(~same & (F.col("n") <= few)).select(*by, "lo", "hi", "rank", "of")
        inner = rows.join(brackets.select(*by, "lo", "hi").distinct(), by).filter("v between lo and hi")
        last = inner.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "lo", "hi").orderBy("v")) - 1)
        found.append(last.join(brackets, [*by, "lo", "hi"]).filter("_r = rank").select(*by, "of", "v"))
        open_ = open_.filter(~same & (F.col("n") > few))
        if open_.isEmpty():
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        inner = rows.join(open_.select(*by, "lo", "hi").distinct(), by).filter("v between lo and hi")
        counts = inner.groupBy(*by, "lo", "hi", part.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*by, "lo", "hi").orderBy("_b")) - F.col("_n")
        counts = counts.withColumn("_before", before)
        narrowed = open_.drop("n").join(counts, [*by, "lo", "hi"]).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        open_ = written(narrowed.select(*by, (F.col("rank") - F.col("_before")).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("n"), "of"))
    values = found[0]
    for part in found[1:]:
        values = values.unionByName(part)
    values = written(values)
    low, high = values.withColumnsRenamed({"of": "_f", "v": "_v0"}), values.withColumnsRenamed({"of": "_c", "v": "_v1"})
    both = asked.withColumns({"_f": F.floor("_at"), "_c": F.ceil("_at")}).join(low, [*by, "_f"]).join(high, [*by, "_c"])
    return both.select(*keys, "q", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_at") - F.col("_f"))).alias("percentile"))


def percentile_columns(df: DataFrame, keys: Sequence[str], names: dict[str, float], value: str = "value") -> DataFrame:
    """HI-3: a row for each group with the exact percentiles as columns. Groups without values have none."""
    rows = exact_percentiles(df, keys, sorted(set(names.values())), value)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == float(q), F.col("percentile"))).alias(n) for n, q in names.items()])

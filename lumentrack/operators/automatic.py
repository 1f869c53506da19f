"""Automatic thresholds that need a whole histogram at once (TH-5), and thresholds of backgrounds by histogram (TH-3) and of edges (TH-8).

A group's histogram has a bounded number of bins however many pixels it stands for, so it is gathered as one array and
the arrays of a batch are worked on where Spark put them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrack.operators.stencils import gaussian, gradient
from lumentrack.session import written

#: Correction of a bin's place, in bins, towards its middle (TH-3).
BIN_OFFSET = 0.245


def dense(hist: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, counts): each group's histogram as an array of ``bins`` counts. Bins outside raise."""
    where = F.when((F.col("bin") < 0) | (F.col("bin") >= bins), F.raise_error(F.lit("a bin outside of the histogram"))).otherwise(F.col("bin")).cast("int")
    filled = hist.groupBy(*keys, where.alias("_b")).agg(F.sum("count").alias("_n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_h"))
    return filled.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_h", i), F.lit(0).cast("long"))).alias("counts"))


def fuzzy(h: np.ndarray) -> int | None:
    """Huang's: the bin after which the classes' fuzziness about their (rounded) means, weighed by count, is least."""
    at = np.flatnonzero(h)
    if not len(at):
        return None
    first, last = at[0], at[-1]
    if first == last:
        return int(first)
    h = h[first : last + 1].astype(float)
    i = np.arange(len(h))
    near = 1 / (1 + i[1:] / (last - first))
    entropy = np.concatenate([[0.0], -near * np.log(near) - np.where(near < 1, (1 - near) * np.log(np.where(near < 1, 1 - near, 1)), 0)])
    n, m = np.cumsum(h), np.cumsum(h * i)
    scores = []
    for t in range(len(h) - 1):
        low, high = np.floor(m[t] / n[t] + 0.5), np.floor((m[-1] - m[t]) / (n[-1] - n[t]) + 0.5)
        far = np.abs(i - np.where(i <= t, low, high)).astype(int)
        scores.append(round(float((entropy[far] * h).sum()), 6))
    return int(first + np.argmin(scores))


def _modes(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1


def _bimodal(h: np.ndarray, most: int = 10000) -> np.ndarray | None:
    """``h`` smoothed over three bins until it has two modes; none once it is log-concave, as it is then unimodal for good."""
    padded = np.zeros(len(h) + 2)
    inner = padded[1:-1]
    inner[:] = h
    for i in range(most):
        if len(_modes(inner)) == 2:
            return inner
        if i % 16 == 0 and (inner > 0).all() and (inner[1:-1] ** 2 >= inner[:-2] * inner[2:]).all():
            return None
        inner[:] = (padded[:-2] + inner + padded[2:]) / 3
    return None


def between_modes(h: np.ndarray) -> int | None:
    """Intermodes: midway between the two modes of the histogram smoothed until it has two; none where it never has."""
    at = np.flatnonzero(h)
    if not len(at):
        return None
    h = _bimodal(h[at[0] : at[-1] + 1].astype(float))
    return None if h is None else int(at[0] + _modes(h).sum() // 2)


def between_modes_lowest(h: np.ndarray) -> int | None:
    """Minimum: the first valley of the histogram smoothed until it has two modes; none where it never has."""
    at = np.flatnonzero(h)
    if not len(at):
        return None
    h = _bimodal(h.astype(float))
    if h is None:
        return None
    valley = np.flatnonzero((h[:-2] > h[1:-1]) & (h[2:] >= h[1:-1]))
    return int(valley[0] + 1) if len(valley) else None


def least_error(h: np.ndarray) -> int | None:
    """MinError: where two normal distributions fitted to the classes are equally likely, found by repetition from the mean on; stays where it is once that has no real solution."""
    if not h.any():
        return None
    i, h = np.arange(len(h), dtype=float), h.astype(float)
    n, m, s = np.cumsum(h), np.cumsum(h * i), np.cumsum(h * i * i)
    t, seen = int(m[-1] // n[-1]), set()
    while t not in seen:
        seen.add(t)
        a, b = n[t], n[-1] - n[t]
        if a == 0 or b == 0:
            return t
        mu, nu = m[t] / a, (m[-1] - m[t]) / b
        v, w = s[t] / a - mu * mu, (s[-1] - s[t]) / b - nu * nu
        if v <= 0 or w <= 0:
            return t
        w0, w1 = 1 / v - 1 / w, mu / v - nu / w
        w2 = mu * mu / v - nu * nu / w + np.log10(v * b * b / (w * a * a))
        root = w1 * w1 - w0 * w2
        if root < 0 or w0 == 0:
            return t
        new = int(np.floor((w1 + np.sqrt(root)) / w0))
        if not 0 <= new < len(h) - 1:
            return t
        t = new
    return t


def even_information(h: np.ndarray) -> int | None:
    """Shanbhag's: the bin at which both classes' information about belonging to them differs least."""
    if not h.any():
        return None
    p = h / h.sum()
    p1 = np.cumsum(p)
    p2 = 1 - p1
    scores = {}
    for t in np.flatnonzero((p1 > 1e-12) & (p2 > 1e-12)):
        low, high = 0.5 / p1[t], 0.5 / p2[t]
        back = -low * (p[1 : t + 1] * np.log(1 - low * p1[:t])).sum()
        front = -high * (p[t + 1 :] * np.log(1 - high * np.maximum(p2[t + 1 :], 0))).sum()
        scores[int(t)] = round(abs(float(back - front)), 6)
    return min(scores, key=lambda t: (scores[t], t)) if scores else None


METHODS: dict[str, Callable[[np.ndarray], int | None]] = {
    "Huang": fuzzy,
    "Intermodes": between_modes,
    "MinError": least_error,
    "Minimum": between_modes_lowest,
    "Shanbhag": even_information,
}


def automatic(hist: DataFrame, keys: Sequence[str], method: str, bins: int = 256) -> DataFrame:
    """TH-5: (keys, threshold_bin) of each group's histogram of ``bins`` bins by one of ``METHODS``; null where the method finds none. Of equal scores, to 6 digits, the lowest bin counts."""
    find = METHODS[method]

    @F.pandas_udf("int")
    def found(counts: pd.Series) -> pd.Series:
        return pd.Series([find(np.asarray(h)) for h in counts], dtype="Int32")

    return dense(hist, keys, bins).select(*keys, found("counts").alias("threshold_bin"))


def kappa_sigma_of_bins(hist: DataFrame, keys: Sequence[str], k: float, k_final: float, rounds: int, bins: int, symmetric: bool = False) -> DataFrame:
    """TH-3: (keys, threshold) of histograms (min and bin_size beside the counts): mean + k sigma of the bins below the last threshold, ``rounds`` times; the last takes ``k_final``.

    A threshold between bins counts the bin below it and once more, at that bin, what is interpolated between it and the
    next. With ``symmetric`` bins under mean - k sigma are left out too. A group rests where its threshold stays (to 9 digits).
    """
    hist = written(hist.select(*keys, "bin", "count", "min", "bin_size"))
    limits = hist.groupBy(*keys).agg(F.first("min").alias("_min"), F.first("bin_size").alias("_size"))
    limits = limits.withColumns({"_t": F.lit(float(bins - 1)), "_low": F.lit(0.0), "_rests": F.lit(False)})
    for i in range(max(rounds, 1)):
        factor = k_final if i >= rounds - 1 else k
        t, b, at = F.col("_t"), F.col("bin"), F.greatest(F.floor("_t"), F.lit(0))
        part = F.when(t <= 0, (b == 0).cast("double")).when(t >= bins - 1, (b == bins - 1).cast("double")).when(b == at, 1 - (t - at)).when(b == at + 1, t - at).otherwise(0.0) * F.col("count")
        below = F.when((b < t) & (b >= F.ceil("_low")), F.col("count")).otherwise(0)
        x, x_at = b + BIN_OFFSET, at + BIN_OFFSET
        rows = hist.join(limits, list(keys)).groupBy(*keys, "_min", "_size", "_t", "_low", "_rests")
        sums = rows.agg(F.sum(below + part).alias("_n"), F.sum(below * x + part * x_at).alias("_m"), F.sum(below * x * x + part * x_at * x_at).alias("_s"))
        mean = F.coalesce(F.col("_m") / F.nullif(F.col("_n"), F.lit(0.0)), F.lit(0.0))
        sigma = F.sqrt(F.greatest(F.coalesce(F.col("_s") / F.nullif(F.col("_n"), F.lit(0.0)), F.lit(0.0)) - mean * mean, F.lit(0.0)))
        new = F.round(F.least(F.lit(float(bins - 1)), mean + factor * sigma), 9)
        rests = F.col("_rests") | (new == t)
        limits = written(sums.select(*keys, "_min", "_size", F.when(rests, t).otherwise(new).alias("_t"), F.when(F.col("_rests") | (F.lit(not symmetric)), F.col("_low")).otherwise(mean - factor * sigma).alias("_low"), rests.alias("_rests")))
    return limits.select(*keys, (F.col("_min") + F.col("_size") * F.col("_t")).alias("threshold"))


def local_contrast(df: DataFrame, keys: Sequence[str], least: float, sigma: float, half: int, images: Sequence[str] = ("frame",)) -> DataFrame:
    """TH-8: (keys, threshold): the mean of the pixels whose smoothed image has a gradient of ``least`` or more; null where there are none. ``images`` tell images apart and hold ``keys``."""
    edges = gradient(gaussian(df.withColumn("_raw", F.col("value")), sigma, half, images), images)
    return edges.groupBy(*keys).agg(F.avg(F.when(F.col("value") >= least, F.col("_raw"))).alias("threshold"))

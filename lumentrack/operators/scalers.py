"""Scalers in two steps: a fit has a row (keys, centre, scale) for each image, channel or track; applied, it scales any pixels that bear its keys.

A fit is as small as its groups are few: ``written`` once, it serves every later step of a chain and is broadcast by Spark
only if its size allows. Histograms are those of ``grouped_bins`` (keys, bin, count, min, bin_size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.operators.histograms import quantile


def fit(df: DataFrame, keys: Sequence[str], centre: Column, scale: Column) -> DataFrame:
    """SC-10: a fit by two aggregates of each group's rows."""
    return df.groupBy(*keys).agg(centre.alias("centre"), scale.alias("scale"))


def mode_values(hist: DataFrame, keys: Sequence[str], bins: int, skip_low: int = 0, skip_high: int = 0) -> DataFrame:
    """SC-5, HI-6: (keys, centre): the lower edge of the fullest bin (the lowest of equals) of those beyond ``skip_low`` bins and before the last ``skip_high`` of ``bins``; null where these are all empty."""
    inside = (F.col("bin") >= max(skip_low, 0)) & (F.col("bin") < bins - max(skip_high, 0))
    top = F.max_by(F.when(inside, F.col("bin")), F.when(inside, F.struct("count", -F.col("bin"))))
    return hist.groupBy(*keys).agg((F.first("min") + F.first("bin_size") * top).alias("centre"))


def mode_range(hist: DataFrame, keys: Sequence[str], width: float, bins: int = 256, skip_low: int = 0, skip_high: int = 0) -> DataFrame:
    """SC-5: the mode to 0, and ``width`` above it to 1."""
    return mode_values(hist, keys, bins, skip_low, skip_high).withColumn("scale", F.lit(float(width)))


def mode_sd(hist: DataFrame, keys: Sequence[str], bins: int = 256, skip_low: int = 0, skip_high: int = 0) -> DataFrame:
    """SC-5: the mode to 0, and a standard deviation of the histogram's values about their mean above it to 1."""
    b, n = F.col("bin").cast("double"), F.col("count")
    moments = hist.groupBy(*keys).agg((F.sum(b * n) / F.sum("count")).alias("_m"), (F.sum(b * b * n) / F.sum("count")).alias("_s"), F.first("bin_size").alias("_size"))
    sd = F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0))) * F.col("_size")
    return mode_values(hist, keys, bins, skip_low, skip_high).join(moments.select(*keys, sd.alias("scale")), list(keys))


def mode_percentile(hist: DataFrame, keys: Sequence[str], q: float, bins: int = 256, skip_low: int = 0, skip_high: int = 0) -> DataFrame:
    """SC-5: the mode to 0 and the histogram's quantile to 1. A group whose quantile isn't above its mode can't be scaled: its scale is null, and so is all that it is applied to."""
    both = mode_values(hist, keys, bins, skip_low, skip_high).join(quantile(hist, keys, q), list(keys), "left")
    width = F.col("quantile") - F.col("centre")
    return both.select(*keys, "centre", F.when(width > 0, width).alias("scale"))


def applied(df: DataFrame, fits: DataFrame, keys: Sequence[str], value: str = "value", power: float | None = None, name: str = "scaled") -> DataFrame:
    """SC-10: (value - centre) / scale, null where the scale is 0 or the group has no fit. With ``power`` values above 1 are bent by it, with 0 cut off."""
    rows = df.join(fits.select(*keys, F.col("centre").alias("_c"), F.col("scale").alias("_s")), list(keys), "left")
    s = (F.col(value) - F.col("_c")) / F.nullif(F.col("_s"), F.lit(0.0))
    if power is not None:
        s = F.when(s > 1, F.pow(s, F.lit(float(power)))).otherwise(s)
    return rows.withColumn(name, s).drop("_c", "_s")


def restored(df: DataFrame, fits: DataFrame, keys: Sequence[str], scaled: str = "scaled", name: str = "value") -> DataFrame:
    """SC-8, SC-10: scaled * scale + centre, by the same fit."""
    rows = df.join(fits.select(*keys, F.col("centre").alias("_c"), F.col("scale").alias("_s")), list(keys), "left")
    return rows.withColumn(name, F.col(scaled) * F.col("_s") + F.col("_c")).drop("_c", "_s")


def saturated(df: DataFrame, limits: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """PX-27: in groups whose maximum is above both their limits (keys, threshold, most), values above the threshold are pressed together so that the maximum becomes ``most``.

    Where both limits are equal that cuts values off. Groups without limits stay as they are. ``most`` below the threshold raises.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    ok = F.when(F.col("most") < F.col("threshold"), F.raise_error(F.lit("most is below the threshold"))).otherwise(F.col("most"))
    rows = df.join(top.join(limits.select(*keys, F.col("threshold").cast("double").alias("_t"), ok.cast("double").alias("_m")), list(keys)), list(keys), "left")
    v, t, m, peak = F.col(value), F.col("_t"), F.col("_m"), F.col("_top")
    pressed = F.when((peak > m) & (peak > t) & (v > t), t + (v - t) * (m - t) / (peak - t)).otherwise(v)
    return rows.withColumn(value, pressed).drop("_top", "_t", "_m")

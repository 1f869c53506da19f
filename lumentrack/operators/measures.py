"""Measurements of objects: one aggregation per table of pixels or children, joined on the object's key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.session import written


def intensity(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """ME-1, ME-3, PX-26: mean, population sigma, sigma over mean, extremes, median, sum."""
    mean, sigma = F.avg(value), F.stddev_pop(value)
    return df.groupBy(*keys).agg(mean.alias("mean"), sigma.alias("sigma"), (sigma / F.nullif(mean, F.lit(0.0))).alias("relative_sigma"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median"), F.sum(value).alias("sum"))


def quantiles(df: DataFrame, keys: Sequence[str], qs: Sequence[float], value: str = "value") -> DataFrame:
    """ME-2: linear interpolation at q (n - 1)."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(f"q{round(q * 100)}") for q in qs])


def geometry(mask: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """ME-4, ME-7: size, bounds, box thickness, and the mean, median and largest length of the object's rows."""
    lines = mask.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    return lines.groupBy(*keys).agg(
        F.sum("_n").alias("pixels"), (F.sum("_n") * scale * scale).alias("area"), F.min("_x0").alias("xmin"), F.max("_x1").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        (F.max("_x1") - F.min("_x0") + 1).alias("thickness_x"), (F.max("y") - F.min("y") + 1).alias("thickness_y"), F.avg("_n").alias("mean_thickness"), F.percentile("_n", F.lit(0.5)).alias("median_thickness"), F.max("_n").alias("max_thickness"),
    )


def feret(contour: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ME-4: largest distance between two contour pixels. The outermost pixels of each row and of each column are enough."""
    ends = contour.groupBy(*keys, "y").agg(F.array(F.min("x"), F.max("x")).alias("_x")).select(*keys, "y", F.explode("_x").alias("x")).distinct()
    b = ends.withColumnsRenamed({"x": "x2", "y": "y2"})
    d2 = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2
    return ends.join(b, list(keys)).groupBy(*keys).agg(F.sqrt(F.max(d2)).alias("feret"))


def centres(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ME-5: geometric centre, and mass centre weighted by the value above the object's least (the geometric one where all are equal)."""
    w = F.col("value") - F.min("value").over(Window.partitionBy(*keys))
    rows = df.withColumn("_w", w)
    mass = lambda c: F.coalesce(F.sum(F.col(c) * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0)), F.avg(c))
    return rows.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), mass("x").alias("mass_x"), mass("y").alias("mass_y"))


def ellipse(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ME-6: axes, orientation in degrees and eccentricity of the ellipse with the object's second moments."""
    m = mask.groupBy(*keys).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    c = F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2)
    major, minor = F.sqrt(F.lit(8.0)) * F.sqrt(F.col("xx") + F.col("yy") + c), F.sqrt(F.lit(8.0)) * F.sqrt(F.greatest(F.col("xx") + F.col("yy") - c, F.lit(0.0)))
    out = m.select(*keys, major.alias("major"), minor.alias("minor"), F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("orientation"))
    return out.withColumn("eccentricity", F.sqrt(F.greatest(1 - F.pow(F.col("minor") / F.nullif(F.col("major"), F.lit(0.0)), F.lit(2)), F.lit(0.0))))


def reduced(children: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """ME-12: children's feature on their parent: weighted mean, mean, sigma, median, extremes, sum."""
    weighted = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))
    return children.groupBy(*keys).agg(weighted.alias("weighted_mean"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"))


def signal_to_noise(objects: DataFrame, background: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ME-14: (mean - background's mean) / background's sigma, the difference, and the ratio of means."""
    back = background.groupBy(*keys).agg(F.avg("value").alias("_b"), F.stddev_pop("value").alias("_s"))
    fore = objects.groupBy(*keys).agg(F.avg("value").alias("_f")).join(back, list(keys))
    d = F.col("_f") - F.col("_b")
    return fore.select(*keys, (d / F.nullif(F.col("_s"), F.lit(0.0))).alias("snr"), d.alias("difference"), (F.col("_f") / F.nullif(F.col("_b"), F.lit(0.0))).alias("ratio"))


def inclusion_counts(overlaps: DataFrame, containers: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """ME-10: objects with at least ``share`` of their size within each container; 0 where there are none."""
    n = overlaps.filter(F.col("overlap") >= share * F.col("size_a")).groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"))
    return containers.join(n, [*keys, "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlap_area(overlaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ME-17: sum and maximum of the overlaps of each object, plain and over its own size."""
    return overlaps.groupBy(*keys, "a").agg(F.sum("overlap").alias("overlap_sum"), F.max("overlap").alias("overlap_max"), (F.sum("overlap") / F.first("size_a")).alias("overlap_share"))


def promoted(df: DataFrame, attributes: str, names: Sequence[str]) -> DataFrame:
    """ME-11, TR-11, ME-19: map entries as numbers; infinities, NaN and what isn't a number are absent."""
    v = lambda n: F.try_element_at(F.col(attributes), F.lit(n)).try_cast("double")
    return df.withColumns({n: F.when(F.isnan(v(n)) | (F.abs(v(n)) == float("inf")), F.lit(None)).otherwise(v(n)) for n in names})


def colocalisation(df: DataFrame, keys: Sequence[str], a: str, b: str, ta: float, tb: float) -> DataFrame:
    """ME-28: Pearson, Manders' M1 and M2, overlap coefficient with its parts k1 and k2, and the ICA quotient, of two channels side by side."""
    ab, aa, bb = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a)), F.sum(F.col(b) * F.col(b))
    over = lambda c, other, t: F.sum(F.when(F.col(other) > t, F.col(c)).otherwise(0.0)) / F.nullif(F.sum(c), F.lit(0.0))
    means = df.withColumns({"_ma": F.avg(a).over(Window.partitionBy(*keys)), "_mb": F.avg(b).over(Window.partitionBy(*keys))})
    ica = F.avg(((F.col(a) - F.col("_ma")) * (F.col(b) - F.col("_mb")) > 0).cast("double")) - 0.5
    return means.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), over(a, b, tb).alias("m1"), over(b, a, ta).alias("m2"), (ab / F.nullif(F.sqrt(aa * bb), F.lit(0.0))).alias("overlap"), (ab / F.nullif(aa, F.lit(0.0))).alias("k1"), (ab / F.nullif(bb, F.lit(0.0))).alias("k2"), ica.alias("icq"))


def cross_correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, shifts: Sequence[int]) -> DataFrame:
    """ME-29: correlation of a with b shifted along x, over all frames of a group."""
    left = df.select(*keys, "frame", "y", F.col("x"), F.col(a).alias("_a"))
    right = df.select(*keys, "frame", "y", F.col("x"), F.col(b).alias("_b"), F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")).withColumn("x", F.col("x") + F.col("shift"))
    return left.join(right, [*keys, "frame", "y", "x"]).groupBy(*keys, "shift").agg(F.corr("_a", "_b").alias("correlation"))


def costes_threshold(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """ME-29: thresholds of two channels of whole numbers (0 to 65,535) by Costes: going down the regression line b = slope a + intercept, those with the least correlation of the pixels below both.

    Columns: keys, slope, intercept, threshold_a, threshold_b, pearson (of pixels at or above both), pearson_below, m1, m2 (each
    channel's share above its threshold). A pixel is below from one step of the line on, so counts and sums are taken by
    that step and summed up along the line: one pass, whatever the number of steps. Of equal correlations (to 12 digits) the lowest
    step counts; where none is as low as the first step's, or the line doesn't rise, the thresholds are the largest values.
    Pixels without either value are left out.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cells = written(cells)
    exact = lambda e: F.sum(e.cast("decimal(28,0)"))
    A, B, N = F.col("_a"), F.col("_b"), F.col("_n")
    parts = {"n": N, "sa": N * A, "sb": N * B, "saa": N * A * A, "sbb": N * B * B, "sab": N * A * B}
    sums = [exact(e).alias(c) for c, e in parts.items()]
    n, sa, sb, saa, sbb, sab = (F.col(c).cast("double") for c in parts)
    r = F.round((n * sab - sa * sb) / F.nullif(F.sqrt(F.greatest((n * saa - sa * sa) * (n * sbb - sb * sb), F.lit(0.0))), F.lit(0.0)), 12)
    below = F.nullif(n * saa - sa * sa, F.lit(0.0))
    line = cells.groupBy(*keys).agg(*sums, F.min("_a").alias("_a0"), F.max("_a").alias("_a1"), F.min("_b").alias("_b0"), F.max("_b").alias("_b1"))
    line = line.select(*keys, ((n * sab - sa * sb) / below).alias("slope"), ((saa * sb - sa * sab) / below).alias("intercept"), "_a0", "_a1", "_b0", "_b1", F.col("sa").alias("_sa"), F.col("sb").alias("_sb"))
    slope, intercept = F.col("slope"), F.col("intercept")
    line = line.withColumns({"_lo": F.greatest(F.col("_a0").cast("double"), (F.col("_b0") - intercept) / F.nullif(slope, F.lit(0.0))).cast("long"), "_hi": F.least(F.col("_a1").cast("double"), (F.col("_b1") - intercept) / F.nullif(slope, F.lit(0.0))).cast("long")})
    line = written(line)
    on_line = lambda i: (slope * i + intercept).cast("long")
    guess = F.ceil((B + 1 - intercept) / slope)
    over_b = F.when(on_line(guess - 1) > B, guess - 1).when(on_line(guess) > B, guess).otherwise(guess + 1)
    steps = cells.join(line.filter("slope > 0"), [*keys]).withColumn("_step", F.greatest(A + 1, over_b, F.col("_lo"))).filter(F.col("_step") <= F.col("_hi"))
    steps = steps.groupBy(*keys, "_step", "_hi").agg(*sums)
    up = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(*keys, "_step", "_hi", *[F.sum(c).over(up).alias(c) for c in parts]).select(*keys, "_step", "_hi", r.alias("_r"))
    first = F.coalesce(F.max_by("_r", "_step"), F.lit(1.0))
    best = F.min(F.when((F.col("_step") < F.col("_hi")) & F.col("_r").isNotNull(), F.struct("_r", "_step")))
    found = steps.groupBy(*keys).agg(first.alias("_first"), best.alias("_best")).filter("_best._r <= _first").select(*keys, F.col("_best._step").alias("_t"), F.col("_best._r").alias("pearson_below"))
    line = line.join(found, [*keys], "left").withColumns({"threshold_a": F.coalesce("_t", "_a1"), "threshold_b": F.when(F.col("_t").isNotNull(), on_line(F.col("_t"))).otherwise(F.col("_b1"))})
    above = cells.join(line.select(*keys, "threshold_a", "threshold_b"), [*keys])
    both = (A >= F.col("threshold_a")) & (B >= F.col("threshold_b"))
    above = above.groupBy(*keys).agg(*[exact(F.when(both, e)).alias(c) for c, e in parts.items()], exact(F.when(A > F.col("threshold_a"), N * A)).alias("_ma"), exact(F.when(B > F.col("threshold_b"), N * B)).alias("_mb"))
    above = above.select(*keys, r.alias("pearson"), "_ma", "_mb")
    share = lambda part, whole: F.coalesce(F.col(part).cast("double"), F.lit(0.0)) / F.nullif(F.col(whole).cast("double"), F.lit(0.0))
    return line.join(above, [*keys]).select(*keys, "slope", "intercept", "threshold_a", "threshold_b", "pearson", "pearson_below", share("_ma", "_sa").alias("m1"), share("_mb", "_sb").alias("m2"))


def costes_randomised(df: DataFrame, keys: Sequence[str], a: str, b: str, width: int, height: int, block: int, rounds: int, seed: int = 0) -> DataFrame:
    """ME-29: (keys, pearson, mean, sd, below) of an image's correlation and those after shifting ``b`` about ``rounds`` times; ``below`` is the share of them below the image's own.

    In a round each row of blocks moves along x by some whole number of blocks, what goes out coming in at the other side, then each
    column of blocks along y. How far is told by a hash of seed, group, round and block, so reruns agree. Pixels beyond the
    last whole block are left out; where a moved pixel meets an absent one the pair is, too.
    """
    w, h = width // block * block, height // block * block
    if w == 0 or h == 0:
        raise ValueError("the block is larger than the image")
    rows = df.filter((F.col("x") < w) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("y") >= 0)).dropna(subset=list(keys))
    pixel = F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    images = rows.groupBy(*keys).agg(F.collect_list(pixel).alias("_p"))
    # Where each block moves in each round; blocks are numbered by whole numbers of 64 bits, rounds of 32.

    def far(axis: str, n: int, m: int) -> Column:
        at = F.sequence(F.lit(0).cast("long"), F.lit(rounds * n - 1).cast("long")) if rounds else F.array().cast("array<bigint>")
        return F.transform(at, lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), *keys, (F.floor(i / n) + 1).cast("int"), i % n), F.lit(m)) * block).cast("int"))

    of = lambda c: F.transform("_p", lambda v: v[c])

    @F.pandas_udf("pearson double, mean double, sd double, below double")
    def compared(y: pd.Series, x: pd.Series, a: pd.Series, b: pd.Series, along: pd.Series, across: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_shifted(*image, w, h, block, rounds) for image in zip(y, x, a, b, along, across, strict=True)], columns=["pearson", "mean", "sd", "below"])

    done = images.select(*keys, compared(of("y"), of("x"), of("a"), of("b"), far("x", h // block, w // block), far("y", w // block, h // block)).alias("_r"))
    return done.select(*keys, "_r.*")


def _shifted(y: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, along: np.ndarray, across: np.ndarray, w: int, h: int, block: int, rounds: int) -> tuple[float, float, float, float]:
    """Of one image the correlation, mean and deviation of those after each round of shifts, and the share of them below it."""
    along, across = along.reshape(rounds, -1), across.reshape(rounds, -1)
    places, at = y.astype(np.int64) * w + x, np.argsort(y.astype(np.int64) * w + x, kind="stable")
    order = places[at]
    found = np.empty(rounds + 1)
    for k in range(rounds + 1):
        if k == 0:
            to = places
        else:
            x1 = (x + along[k - 1, y // block]) % w
            to = (y + across[k - 1, x1 // block]).astype(np.int64) % h * w + x1
        first, n = np.searchsorted(order, to), np.searchsorted(order, to, "right") - np.searchsorted(order, to)
        mine = np.repeat(np.arange(len(to)), n)
        p, q = a[at[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(mine))]], b[mine]
        known = ~(np.isnan(p) | np.isnan(q))
        p, q = p[known], q[known]
        if len(p) > 1:
            # Sums in order of a's place, so that a round that moves nothing has the same.
            s = np.argsort(to[mine][known], kind="stable")
            p, q = p[s] - p[s].mean(), q[s] - q[s].mean()
            spread = np.sqrt((p * p).sum() * (q * q).sum())
            found[k] = (p * q).sum() / spread if spread > 0 else np.nan
        else:
            found[k] = np.nan
    own, others = found[0], found[1:][~np.isnan(found[1:])]
    n = len(others)
    return own, others.mean() if n else np.nan, others.std(ddof=1) if n > 1 else np.nan, (others < own).mean() if n else np.nan


def distance_index(df: DataFrame, keys: Sequence[str], distance: str = "distance") -> DataFrame:
    """ME-30: rank of each pixel's distance over the number of pixels, equal distances sharing their mean rank: near 0 at the edge, 1 at the centre."""
    w, ties, whole = Window.partitionBy(*keys).orderBy(distance), Window.partitionBy(*keys, distance), Window.partitionBy(*keys)
    return df.withColumn("index", (F.rank().over(w) - 1 + (F.count(F.lit(1)).over(ties) - 1) / 2 + 1) / F.count(F.lit(1)).over(whole))


def shells(df: DataFrame, keys: Sequence[str], n: int, value: str = "value") -> DataFrame:
    """ME-31: share of each object's signal in ``n`` shells of equal numbers of pixels by rising index; ties in order of y, x."""
    w, whole = Window.partitionBy(*keys).orderBy("index", "y", "x"), Window.partitionBy(*keys)
    shell = F.floor((F.row_number().over(w) - 1) * n / F.count(F.lit(1)).over(whole)).cast("int")
    rows = df.withColumn("shell", shell).groupBy(*keys, "shell").agg(F.sum(value).alias("_s"))
    return rows.select(*keys, "shell", (F.col("_s") / F.nullif(F.sum("_s").over(whole), F.lit(0.0))).alias("share"))


def segmentation_metrics(truth: DataFrame, predicted: DataFrame, matches: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """ME-25: per frame the objects of both sides, those without a match, and the surplus of matches of each side (over- and under-segmentation); intersection and union."""
    of_truth = matches.groupBy(*keys, F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("o"))
    of_pred = matches.groupBy(*keys, F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return segmentation_totals(truth, predicted, of_truth, of_pred, keys)


def segmentation_totals(truth: DataFrame, predicted: DataFrame, of_truth: DataFrame, of_pred: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """ME-25: ``segmentation_metrics`` from the number of matches ``n`` of each object (keys, key) that has any, and its common pixels ``o`` (of the truth)."""
    n = F.coalesce(F.col("n"), F.lit(0))
    t = truth.join(of_truth, [*keys, "key"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("gt_count"), F.count_if(n == 0).alias("false_negative"), F.sum(F.greatest(n - 1, F.lit(0))).alias("over_segmentation"), F.coalesce(F.sum("o"), F.lit(0)).alias("intersection"))
    p = predicted.join(of_pred, [*keys, "key"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("prediction_count"), F.count_if(n == 0).alias("false_positive"), F.sum(F.greatest(n - 1, F.lit(0))).alias("under_segmentation"))
    return t.join(p, list(keys), "full").fillna(0)


def link_metrics(truth: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """ME-26: per frame of the later end, links (frame, src, dst) of the truth, those that the prediction lacks and those that it adds, mapped through one-to-one ``pairs`` (gt, pred)."""
    src, dst = (pairs.select(F.col("pred").alias(end), F.col("gt").alias(f"_{end}")) for end in ("src", "dst"))
    mapped = predicted.join(src, "src", "left").join(dst, "dst", "left").select("frame", F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    on = ["frame", "src", "dst"]
    hit = truth.join(mapped.distinct(), on, "left_semi").groupBy("frame").agg(F.count(F.lit(1)).alias("_hit"))
    t, p = truth.groupBy("frame").agg(F.count(F.lit(1)).alias("gt_links")), predicted.groupBy("frame").agg(F.count(F.lit(1)).alias("_p"))
    both = t.join(p, "frame", "full").join(hit, "frame", "left").fillna(0)
    return both.select("frame", "gt_links", (F.col("gt_links") - F.col("_hit")).alias("false_negative_links"), (F.col("_p") - F.col("_hit")).alias("false_positive_links"))


def regression(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """ME-24, ME-23: least squares; null for one point."""
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.count(F.lit(1)).alias("n"))


def border_contact(mask: DataFrame, width: int, height: int, keys: Sequence[str]) -> DataFrame:
    """FI-5, ME-16, ME-35: pixels of each object at each side of the image."""
    at = lambda c: F.count_if(c)
    return mask.groupBy(*keys).agg(at(F.col("x") == 0).alias("x_low"), at(F.col("x") == width - 1).alias("x_high"), at(F.col("y") == 0).alias("y_low"), at(F.col("y") == height - 1).alias("y_high"))


def trimmed_at_end(mask: DataFrame, parents: DataFrame, keys: Sequence[str], *, share: float = 0.25, size: int = 300, side_share: float = 0.0, keep_only: bool = True) -> DataFrame:
    """FI-15: (keys, object_id) of the objects that the open end of their parent cuts off: the parents' largest y.

    An object's width is its size over its Feret diameter. One that touches the end goes if it has fewer than ``size`` pixels, or if
    its pixels there are ``share`` of its width or more; likewise with ``side_share`` at the parent's least and largest x. A
    share of 0 leaves its test out. With ``keep_only`` the only object of a parent stays. ``parents`` are pixels (keys, y, x) of boxes.
    """
    box = parents.groupBy(*keys).agg(F.max("y").alias("_end"), F.min("x").alias("_left"), F.max("x").alias("_right"))
    by = [*keys, "object_id"]
    at = mask.join(box, list(keys)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == F.col("_end")).alias("_e"), F.count_if((F.col("x") == F.col("_left")) | (F.col("x") == F.col("_right"))).alias("_s"))
    # Only objects in touch are measured.
    touch = at.filter((F.lit(share > 0) & (F.col("_e") > 0)) | (F.lit(side_share > 0) & (F.col("_s") > 0)))
    long = feret(mask.join(touch.select(*by), by, "left_semi"), by)
    width = F.col("_n") / F.nullif(F.col("feret"), F.lit(0.0))
    cut = lambda c, part: F.lit(part > 0) & (F.col(c) > 0) & ((F.lit(size > 0) & (F.col("_n") < size)) | (F.coalesce(F.col(c) / width, F.lit(0.0)) >= part))
    gone = touch.join(long, by).filter(cut("_e", share) | cut("_s", side_share)).select(*by)
    if not keep_only:
        return gone
    several = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*keys)
    return gone.join(several, list(keys), "left_semi")


def measured(base: DataFrame, keys: Sequence[str], *tables: DataFrame) -> DataFrame:
    """ME-13, PL-5: measurement tables side by side on the object's key."""
    for t in tables:
        base = base.join(t, list(keys), "left")
    return base


def kept(df: DataFrame, feature: Column, threshold: float, over: bool = True, strict: bool = True) -> DataFrame:
    """FI-1 to FI-4, FI-6: objects whose feature is over (under) the threshold; NaN never passes."""
    test = (feature > threshold if strict else feature >= threshold) if over else (feature < threshold if strict else feature <= threshold)
    return df.filter(~F.isnan(feature.cast("double")) & test)


def sized(df: DataFrame, least: float = -1, most: float = -1, size: str = "size") -> DataFrame:
    """FI-3: least <= size < most; -1 leaves an end open."""
    out = df if least < 0 else df.filter(F.col(size) >= least)
    return out if most < 0 else out.filter(F.col(size) < most)


def largest(df: DataFrame, keys: Sequence[str], n: int = 1, size: str = "size", tie: Sequence[str] = ("idx",)) -> DataFrame:
    """FI-8: the n largest objects of each parent, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(size), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def relabelled(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """FI-8, TR-16, SR-10: ``label`` counts the objects of each parent from 1 in order."""
    return df.withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def merged_touching(mask: DataFrame, keys: Sequence[str] = ("frame",), name: str = "object_id") -> DataFrame:
    """FI-9: objects with pixels side by side become one, named by the smallest of them."""
    from lumentrack.functions.components import connected_components

    a = mask.select(*keys, "y", "x", F.col(name).alias("a"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))])).alias("d")
    b = mask.select(*keys, "y", "x", F.col(name).alias("b"), steps).select(*keys, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "b")
    edges = a.join(b, [*keys, "y", "x"]).filter("a <> b").select(F.struct(*keys, F.col("a").alias("o")).alias("src"), F.struct(*keys, F.col("b").alias("o")).alias("dst")).distinct()
    named = connected_components(edges).select(F.col("node"), F.col("component.o").alias("_to"))
    out = mask.withColumn("_k", F.struct(*keys, F.col(name).alias("o"))).join(named, F.col("_k") == F.col("node"), "left")
    return out.withColumn(name, F.coalesce("_to", name)).drop("_k", "node", "_to")

"""Neighbourhood operators over (frame, y, x, value). Each pixel is dealt to the places whose neighbourhoods it is in, and these are grouped."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.operators.histograms import exact_percentiles

KEYS = ("frame",)


def disc(rx: int, ry: int) -> list[tuple[int, int]]:
    """Offsets of an ellipse, its middle included."""
    return [(dx, dy) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1) if (dx / max(rx, 1)) ** 2 + (dy / max(ry, 1)) ** 2 <= 1 + 1e-9]


def square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def dealt(df: DataFrame, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = KEYS, columns: Sequence[str] = ("value",)) -> DataFrame:
    """A row for each pixel and each place (y, x) of the image whose neighbourhood it is in, with its offset dx, dy from there."""
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])).alias("d")
    spread = df.select(*keys, "y", "x", *columns, near)
    spread = spread.select(*keys, (F.col("y") - F.col("d.dy")).alias("y"), (F.col("x") - F.col("d.dx")).alias("x"), F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"), *columns)
    return spread.join(df.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def filtered(df: DataFrame, offsets: Sequence[tuple[int, int]], *aggregates: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-2, ST-3, ST-7: aggregates of ``value`` over each pixel's neighbourhood; beyond the image there is nothing."""
    return dealt(df, offsets, keys).groupBy(*keys, "y", "x").agg(*aggregates)


def mean(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return filtered(df, offsets, F.avg("value").alias("value"))


def median(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return filtered(df, offsets, F.percentile("value", F.lit(0.5)).alias("value"))


def dilated(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return filtered(df, offsets, F.max("value").alias("value"))


def eroded(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return filtered(df, offsets, F.min("value").alias("value"))


def opened(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return dilated(eroded(df, offsets), offsets)


def closed(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return eroded(dilated(df, offsets), offsets)


def top_hat(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    low = opened(df, offsets).withColumnRenamed("value", "_o")
    return df.join(low, [*KEYS, "y", "x"]).withColumn("value", F.col("value") - F.col("_o")).drop("_o")


def entropy(df: DataFrame, offsets: Sequence[tuple[int, int]], width: float) -> DataFrame:
    """ST-7: entropy of the neighbourhood's values in bins of a width: the logarithm of their number less the mean of those of the bins' counts. A pixel deals its bin, and to its own place that there is one, so places aren't looked up."""
    own = (0, 0)
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(int((dx, dy) in offsets)).alias("n")) for dx, dy in dict.fromkeys([*offsets, own])]))
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in (*KEYS, "y", "x"))).select(*KEYS, "y", "x", F.floor(F.col("value") / width).alias("_b"), near.alias("d"))
    rows = rows.select(*KEYS, (F.col("y") - F.col("d.dy")).alias("y"), (F.col("x") - F.col("d.dx")).alias("x"), "_b", F.col("d.n").alias("_n"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("_own"))
    # Dealt by place before anything is counted: both groupings then have their rows, and no task counts those of a whole split of the input.
    counts = rows.repartition(*KEYS, "y", "x").groupBy(*KEYS, "y", "x", "_b").agg(F.sum("_n").alias("_n"), F.max("_own").alias("_own"))
    sums = counts.groupBy(*KEYS, "y", "x").agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_n") > 0, F.col("_n") * F.log("_n"))).alias("_s"), F.max("_own").alias("_own"))
    return sums.filter("_own and _all > 0").select(*KEYS, "y", "x", (F.log("_all") - F.col("_s") / F.col("_all")).alias("value"))


def local_extrema(df: DataFrame, offsets: Sequence[tuple[int, int]], over: float | None = None) -> DataFrame:
    """ST-5: pixels that none of their neighbourhood exceeds, above a threshold."""
    top = dilated(df, offsets).withColumnRenamed("value", "_m")
    out = df.join(top, [*KEYS, "y", "x"]).filter(F.col("value") == F.col("_m")).drop("_m")
    return out if over is None else out.filter(F.col("value") > over)


def without_background(df: DataFrame, offsets: Sequence[tuple[int, int]], divide: bool = False) -> DataFrame:
    """ST-6: less the local mean, or over it."""
    back = mean(df, offsets).withColumnRenamed("value", "_b")
    v = F.col("value") / F.nullif(F.col("_b"), F.lit(0.0)) if divide else F.col("value") - F.col("_b")
    return df.join(back, [*KEYS, "y", "x"]).withColumn("value", v).drop("_b")


def gaussian(df: DataFrame, sigma: float, half: int, keys: Sequence[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """ST-4, ST-8: separable Gaussian, renormalised at borders and absent pixels; with ``weight`` 0 a pixel is left out of the sums.

    Two passes of 2 half + 1 window terms each, so nothing is multiplied by the kernel's area.
    """
    rows = df.withColumns({"_n": F.col("value") * (F.lit(1.0) if weight is None else weight), "_d": F.lit(1.0) if weight is None else weight.cast("double")})
    for along, across in (("x", "y"), ("y", "x")):
        # By place rather than by row: pixels may be absent.
        w = Window.partitionBy(*keys, across).orderBy(along)
        sums = {c: F.lit(0.0) for c in ("_n", "_d")}
        for k in range(-half, half + 1):
            g = math.exp(-k * k / (2 * sigma * sigma))
            at = w.rangeBetween(k, k)
            sums = {c: s + g * F.coalesce(F.first(c).over(at), F.lit(0.0)) for c, s in sums.items()}
        rows = rows.withColumns(sums)
    return rows.withColumn("value", F.col("_n") / F.nullif(F.col("_d"), F.lit(0.0))).drop("_n", "_d")


def gradient(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-4: magnitude of the central differences (one-sided at borders)."""
    def along(axis: str, across: str) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(axis)
        a, b = F.first("value").over(w.rangeBetween(1, 1)), F.first("value").over(w.rangeBetween(-1, -1))
        steps = a.isNotNull().cast("int") + b.isNotNull().cast("int")
        return (F.coalesce(a, "value") - F.coalesce(b, "value")) / F.nullif(steps, F.lit(0))

    rows = df.withColumns({"_gx": along("x", "y"), "_gy": along("y", "x")})
    return rows.withColumn("value", F.sqrt(F.coalesce(F.col("_gx"), F.lit(0.0)) ** 2 + F.coalesce(F.col("_gy"), F.lit(0.0)) ** 2)).drop("_gx", "_gy")


def hessian(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-4: eigenvalues (large, small), determinant and trace (the Laplacian) of second differences, at pixels with all eight neighbours."""
    near = dealt(df, square(1), keys)
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("value")))
    xx = at(1, 0) - 2 * at(0, 0) + at(-1, 0)
    yy = at(0, 1) - 2 * at(0, 0) + at(0, -1)
    xy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / 4
    rows = near.groupBy(*keys, "y", "x").agg(xx.alias("xx"), yy.alias("yy"), xy.alias("xy"), F.count(F.lit(1)).alias("_n")).filter("_n = 9")
    root = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2)) + F.col("xy") * F.col("xy"))
    half = (F.col("xx") + F.col("yy")) / 2
    return rows.select(*keys, "y", "x", (half + root).alias("large"), (half - root).alias("small"), (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).alias("determinant"), (2 * half).alias("laplacian"))


def lower_envelope(f: np.ndarray, step: float) -> np.ndarray:
    """For each place i the least f[j] + (step (i - j))^2, by the parabolas that are lowest somewhere; infinite ones are left out."""
    at = np.flatnonzero(np.isfinite(f)).tolist()
    if not at:
        return np.full(len(f), np.inf)
    unit = step * step
    low, till = [at[0]], [-math.inf]
    for j in at[1:]:
        while True:
            i = low[-1]
            cross = ((f[j] - f[i]) / unit + j * j - i * i) / (2 * (j - i))
            if cross > till[-1]:
                break
            low.pop()
            till.pop()
        low.append(j)
        till.append(cross)
    places = np.arange(len(f))
    mine = np.array(low)[np.searchsorted(np.array(till), places, "left") - 1]
    return f[mine] + unit * (places - mine) ** 2


def _along(df: DataFrame, axis: str, group: Sequence[str], step: float, borders: tuple[int, int | Column] | None) -> DataFrame:
    """One pass of the transform: ``_d2`` along an axis, run by run of pixels without a gap; both ends of a run are outside, but where ``borders`` of the image say that nothing is known beyond."""
    w = Window.partitionBy(*group).orderBy(axis)
    runs = df.withColumn("_run", F.col(axis) - F.row_number().over(w)).groupBy(*group, "_run").agg(F.array_sort(F.collect_list(F.struct(axis, "_d2"))).alias("_c"))
    first, last = F.col("_c")[0][axis], F.element_at("_c", -1)[axis]
    beyond = lambda at, border: F.lit(0.0) if border is None else F.when(at == border, F.lit(float("inf"))).otherwise(0.0)
    ends = F.array(beyond(first, None if borders is None else borders[0]), beyond(last, None if borders is None else borders[1]))

    @F.pandas_udf("array<double>")
    def lowest(values: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([lower_envelope(np.concatenate([e[:1], v, e[1:]]), step)[1:-1] for v, e in zip(values, ends, strict=True)])

    done = runs.withColumn("_v", lowest(F.transform("_c", lambda c: c["_d2"]), ends))
    return done.select(*group, F.explode(F.arrays_zip(F.transform("_c", lambda c: c[axis]).alias(axis), F.col("_v").alias("_d2"))).alias("_e")).select(*group, F.col(f"_e.{axis}").alias(axis), F.col("_e._d2").alias("_d2"))


def distance_transform(
    mask: DataFrame, width: int, height: int, keys: Sequence[str] = KEYS, scale: float = 1.0, *, depth: int | None = None, scale_z: float | None = None, inside: bool = True, border: bool = True
) -> DataFrame:
    """ST-1: distance of each mask pixel to the nearest pixel outside of the mask, or with ``inside`` false of each other pixel of the image to the mask.

    With ``depth`` pixels have a plane ``z`` too, whose step is ``scale_z``. With ``border`` what is beyond the image
    counts as the nearest other pixel could; without it as nothing, and where there is no other pixel the distance is
    null. Exact: an envelope of parabolas for each run of pixels along x, then y, then z, each in one pass over its
    pixels. A task holds runs, no more than an image's side.
    """
    axes = [("x", width, scale), ("y", height, scale), *([("z", depth, scale if scale_z is None else scale_z)] if depth is not None else [])]
    at = [*keys, *(a for a, _, _ in axes)]
    rows = mask.select(*at).distinct()
    if not inside:
        grid = mask.select(*keys).distinct()
        for axis, n, _ in axes:
            grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = grid.join(rows, at, "left_anti")
    rows = rows.withColumn("_d2", F.lit(float("inf")))
    for axis, n, step in axes:
        rows = _along(rows, axis, [c for c in at if c != axis], step, None if border and inside else (0, n - 1))
    distance = F.when(F.col("_d2") < float("inf"), F.sqrt("_d2"))
    return rows.select(*at, distance.alias("distance"))


def distance_fields(points: DataFrame, reach: int, keys: Sequence[str]) -> DataFrame:
    """ST-1: (keys, y, x, distance) to the nearest of a group's points, at every place of its box widened by ``reach`` on all sides.

    Each group has a window of its own, so the work grows with the objects' boxes and not with the image. Repeated points
    count once; without points there is no field.
    """
    points = points.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    box = points.groupBy(*keys).agg(*[e for c in "yx" for e in ((F.min(c) - reach).alias(f"_{c}0"), (F.max(c) - F.min(c) + 2 * reach).alias(f"_{c}1"))])
    group = [*keys, "_y0", "_y1", "_x0", "_x1"]
    inner = points.join(box, [*keys]).select(*group, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"))
    grid = box.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), "_y1"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), "_x1")))
    rows = grid.join(inner, [*keys, "y", "x"], "left_anti").withColumn("_d2", F.lit(float("inf")))
    for axis, other in (("x", "y"), ("y", "x")):
        rows = _along(rows, axis, [*group, other], 1.0, (0, F.col(f"_{axis}1")))
    field = rows.select(*group, "y", "x", F.sqrt("_d2").alias("distance")).unionByName(inner.withColumn("distance", F.lit(0.0)))
    return field.select(*keys, (F.col("y") + F.col("_y0")).alias("y"), (F.col("x") + F.col("_x0")).alias("x"), "distance")


def destriped(df: DataFrame, foreground: Column, keys: Sequence[str] = KEYS, add_back: bool = True) -> DataFrame:
    """ST-9: each row less the mean of its background pixels, with the frame's background mean added back."""
    back = F.when(~foreground, F.col("value"))
    line, whole = F.avg(back).over(Window.partitionBy(*keys, "y")), F.avg(back).over(Window.partitionBy(*keys))
    return df.withColumn("value", F.col("value") - F.coalesce(line, whole, F.lit(0.0)) + (F.coalesce(whole, F.lit(0.0)) if add_back else F.lit(0.0)))


def without_hot_pixels(df: DataFrame, frames: int, limit: float) -> DataFrame:
    """ST-10: where the mean over the last ``frames`` exceeds the spatial median by ``limit`` the median is put."""
    still = F.avg("value").over(Window.partitionBy("y", "x").orderBy("frame").rowsBetween(-(frames - 1), 0))
    flat = median(df, square(1)).withColumnRenamed("value", "_m")
    rows = df.withColumn("_s", still).join(flat, [*KEYS, "y", "x"])
    return rows.withColumn("value", F.when(F.col("_s") - F.col("_m") >= limit, F.col("_m")).otherwise(F.col("value"))).drop("_s", "_m")


def focus(df: DataFrame, plane: str = "z", keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-11: plane of the largest mean gradient (the lowest of equals), with the score."""
    score = gradient(df, [*keys, plane]).groupBy(*keys, plane).agg(F.round(F.avg("value"), 9).alias("score"))
    return score.groupBy(*keys).agg(F.max_by(plane, F.struct("score", -F.col(plane))).alias(plane), F.max("score").alias("score"))


def without_line_background(df: DataFrame, q: float, keys: Sequence[str], line: str = "y") -> DataFrame:
    """TR-33: each value less a low quantile of its row (or with ``line`` x its column) over all images of the group, such as a track. A line of a long track is never in one task."""
    low = exact_percentiles(df, [*keys, line], [q]).select(*keys, line, F.col("percentile").alias("_low"))
    return df.join(low, [*keys, line], "left").withColumn("value", F.col("value") - F.col("_low")).drop("_low")


def around_focus(df: DataFrame, first: int, last: int, plane: str = "z", keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-12: of each stack the planes from ``first`` to ``last`` places beyond the sharpest one (below it if negative), as far as there are any, counted anew from 0. Planes are whole numbers."""
    sharp = focus(df, plane, keys).select(*keys, F.col(plane).alias("_f"))
    rows = df.join(sharp, list(keys)).filter(F.col(plane).between(F.col("_f") + first, F.col("_f") + last))
    low = rows.groupBy(*keys).agg(F.min(plane).alias("_low"))
    return rows.join(low, list(keys)).withColumn(plane, F.col(plane) - F.col("_low")).drop("_f", "_low")


def half_shell(radius: float) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of a ring one pixel wide up to ``radius``, one of each opposite pair; for radii that aren't whole, both of those that lie in the row and one short of the rounded radius."""
    reach = int(radius + 0.5)
    inner = (radius - 1) ** 2 if radius >= 1 else 0.0
    rows = [(dx, 0) for dx in range(1 - reach, reach + 1)] + [(dx, dy) for dy in range(1, reach + 1) for dx in range(-reach, reach + 1)]
    return [(dx, dy) for dx, dy in rows if inner < dx * dx + dy * dy <= radius * radius]


def radial_autocorrelation(df: DataFrame, radii: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """ST-14: (keys, radius, pairs, correlation): the mean of (v - m)(v' - m) over pairs of pixels of one object (``keys``) at each radius, over the object's variance.

    Objects without any such pair have 0 pairs; the correlation is 0 then, and where all values are equal. All radii share one join.
    """
    stats = df.groupBy(*keys).agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    px = df.join(stats, list(keys)).select(*keys, "y", "x", (F.col("value") - F.col("_m")).alias("_d"))
    steps = F.array(*[F.struct(F.lit(float(r)).alias("r"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for r in radii for dx, dy in half_shell(r)])
    moved = px.select(*keys, "y", "x", F.col("_d").alias("_e"), F.explode(steps).alias("s"))
    moved = moved.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "_e", F.col("s.r").alias("radius"))
    found = moved.join(px, [*keys, "y", "x"]).groupBy(*keys, "radius").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("_e") * F.col("_d")).alias("_c"))
    rows = stats.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).join(found, [*keys, "radius"], "left")
    return rows.select(*keys, "radius", F.coalesce("_n", F.lit(0).cast("long")).alias("pairs"), F.coalesce(F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")), F.lit(0.0)).alias("correlation"))


def filled_holes(mask: DataFrame, width: int, height: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """ST-13: the mask with the parts of its outside that don't reach the image's border."""
    from lumentrack.operators.pixels import components

    grid = mask.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    parts = components(grid.join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti"), keys, low=True)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    open_ = parts.filter(edge).select(*keys, "object_id").distinct()
    return mask.select(*keys, "y", "x").unionByName(parts.join(open_, [*keys, "object_id"], "left_anti").select(*keys, "y", "x")).distinct()


def local_thickness(mask: DataFrame, width: int, height: int, keys: Sequence[str] = KEYS, scale: float = 1.0) -> DataFrame:
    """ME-20: for each mask pixel the diameter (``thickness``) of the largest ball within the mask that has the pixel.

    Balls are centred on pixels and reach to the nearest pixel outside. Those that lie within a neighbour's ball can't
    be the largest and are left out first, which leaves the ridge of the distances. Each of the rest is then dealt to
    the rows of pixels that it crosses, and each pixel takes the largest; a ball's pixels are bounded by its object.
    """
    d = distance_transform(mask, width, height, keys).withColumn("_r2", F.round(F.col("distance") * F.col("distance")).cast("long"))
    near = dealt(d.select(*keys, "y", "x", "distance"), [o for o in square(1) if o != (0, 0)], keys, ["distance"])
    # The neighbour stands at x + dx, y + dy: its ball has this one's if its radius is greater by the way between them.
    way = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    cover = near.groupBy(*keys, "y", "x").agg(F.max(F.col("distance") - way).alias("_cover"))
    ridge = d.join(cover, [*keys, "y", "x"], "left").filter(F.col("_cover").isNull() | (F.col("_cover") < F.col("distance")))
    reach = F.ceil("distance") - 1
    lines = ridge.withColumn("_dy", F.explode(F.sequence(-reach, reach))).withColumn("_left", F.col("_r2") - F.col("_dy") * F.col("_dy")).filter("_left > 0")
    # Whole steps h with h^2 < what is left of the squared radius.
    half = F.ceil(F.sqrt(F.col("_left").cast("double"))) - 1
    balls = lines.withColumn("x", F.explode(F.sequence(F.col("x") - half, F.col("x") + half))).withColumn("y", F.col("y") + F.col("_dy"))
    best = balls.groupBy(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("distance").alias("_d"))
    return d.select(*keys, "y", "x").join(best, [*keys, "y", "x"]).select(*keys, "y", "x", (2 * scale * F.col("_d")).alias("thickness"))

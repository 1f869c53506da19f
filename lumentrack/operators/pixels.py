"""Pixel operators over tables (frame, [z,] y, x, value). Images are sparse or dense: absent pixels are absent rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ("frame", "y", "x")


def point(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """PX-1, PX-2, PX-30: a function of each value."""
    return df.withColumn("value", f(F.col("value")))


def combined(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], at: Sequence[str] = AT) -> DataFrame:
    """PX-1, PX-3, PX-17: a function of two images' values at the same place."""
    return a.join(b.select(*at, F.col("value").alias("_b")), list(at)).withColumn("value", f(F.col("value"), F.col("_b"))).drop("_b")


def threshold(df: DataFrame, t: float, over: bool = True, strict: bool = True) -> DataFrame:
    """PX-5: the foreground."""
    v = F.col("value")
    return df.filter((v > t if strict else v >= t) if over else (v < t if strict else v <= t))


def mask_xor(a: DataFrame, b: DataFrame, at: Sequence[str] = AT) -> DataFrame:
    """PX-6: places in one mask only; or, and, and-not are union, intersect and exceptAll of the places."""
    return a.select(*at).distinct().withColumn("_n", F.lit(1)).unionByName(b.select(*at).distinct().withColumn("_n", F.lit(2))).groupBy(*at).agg(F.sum("_n").alias("_n")).filter("_n < 3").drop("_n")


def clamp(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """PX-7."""
    v = F.col("value")
    v = v if low is None else F.greatest(v, F.lit(low))
    return df.withColumn("value", v if high is None else F.least(v, F.lit(high)))


def projected(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """PX-4, PX-9, PX-10: mean, maximum and sigma over all places that share ``axes``."""
    return df.groupBy(*axes).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("sigma"))


def autocorrelation(df: DataFrame, lag: int, at: Sequence[str] = ("y", "x"), order: str = "frame") -> DataFrame:
    """PX-9: over the stack, mean of (v - m)(v' - m) at a frame distance, over the variance."""
    w, whole = Window.partitionBy(*at).orderBy(order), Window.partitionBy(*at)
    m = F.avg("value").over(whole)
    d = df.withColumn("_d", F.col("value") - m)
    d = d.withColumn("_e", F.lead("_d", lag).over(w))
    return d.groupBy(*at).agg((F.avg(F.col("_d") * F.col("_e")) / F.nullif(F.avg(F.col("_d") * F.col("_d")), F.lit(0.0))).alias("autocorrelation"))


def planes(df: DataFrame, which: str, keys: Sequence[str] = ("frame",), first: int | None = None, last: int | None = None) -> DataFrame:
    """PX-16: of each stack (``z`` within ``keys``) the 'top', 'bottom' or 'middle' plane (the upper of two), those from ``first`` to ``last`` ('interval'), 'all', or their 'average' (``z`` is null then)."""
    if which == "all":
        return df
    if which == "interval":
        return df.filter(F.col("z").between(first, last))
    if which == "average":
        return df.groupBy(*keys, "y", "x").agg(F.avg("value").alias("value")).withColumn("z", F.lit(None).cast(df.schema["z"].dataType))
    ends = df.groupBy(*keys).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    place = {"top": F.col("_lo"), "bottom": F.col("_hi"), "middle": F.floor((F.col("_lo") + F.col("_hi") + 1) / 2)}[which]
    return df.join(ends, list(keys)).filter(F.col("z") == place).drop("_lo", "_hi")


def mixed(channels: Sequence[tuple[DataFrame, float]], how: str = "sum", at: Sequence[str] = AT) -> DataFrame:
    """PX-17: channels, scaled beforehand or not, put together by their weighted 'sum', or the 'max' or 'average' of weighted values; places that a channel lacks go."""
    rows = [df.select(*at, (F.col("value") * w).alias("value")) for df, w in channels]
    for other in rows[1:]:
        rows[0] = rows[0].unionByName(other)
    f = {"sum": F.sum, "max": F.max, "average": F.avg}[how]
    return rows[0].groupBy(*at).agg(f("value").alias("value"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(channels)).drop("_n")


def binned(df: DataFrame, fx: int, fy: int) -> DataFrame:
    """PX-11: spatial binning, mean and maximum."""
    cells = df.select("frame", F.floor(F.col("y") / fy).cast("int").alias("y"), F.floor(F.col("x") / fx).cast("int").alias("x"), "value")
    return cells.groupBy("frame", "y", "x").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))


def cropped(df: DataFrame, x0: int, x1: int, y0: int, y1: int, rebase: bool = True) -> DataFrame:
    """PX-12, SR-3: pixels in an inclusive box, from (0, 0) again if ``rebase``."""
    out = df.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return out.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0}) if rebase else out


def moved(df: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def flipped(df: DataFrame, width: int, axis: str = "x") -> DataFrame:
    return df.withColumn(axis, width - 1 - F.col(axis))


def turned(df: DataFrame, height: int) -> DataFrame:
    """A quarter turn: row y becomes column height - 1 - y."""
    return df.withColumns({"x": F.lit(height - 1) - F.col("y"), "y": F.col("x")})


def padded(df: DataFrame, width: int, height: int, border: int) -> DataFrame:
    """PX-13: each border pixel repeated outwards; coordinates keep their origin."""

    def spread(c: str, n: int) -> Column:
        low = F.when(F.col(c) == 0, -border).otherwise(F.col(c))
        high = F.when(F.col(c) == n - 1, n - 1 + border).otherwise(F.col(c))
        return F.explode(F.sequence(low, high))

    return df.withColumn("_x", spread("x", width)).withColumn("_y", spread("y", height)).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")


def tiles(df: DataFrame, size: int, halo: int) -> DataFrame:
    """PX-13: pixels dealt to tiles of ``size`` with ``halo`` more on each side; a pixel is in every tile that it reaches."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    return df.withColumn("tile_x", reach("x")).withColumn("tile_y", reach("y"))


def merged_tiles(df: DataFrame) -> DataFrame:
    """PX-13: overlapping tiles put together, averaged where they overlap."""
    return df.groupBy(*AT).agg(F.avg("value").alias("value"))


def shading_corrected(df: DataFrame, flat: DataFrame, dark: float = 0.0) -> DataFrame:
    """PX-18: (value - dark) / flat, where ``flat`` has a value per (y, x) relative to its mean."""
    mean = flat.agg(F.avg("value").alias("_m"))
    field = flat.select("y", "x", F.col("value").alias("_f")).crossJoin(F.broadcast(mean))  # one row
    return df.join(field, ["y", "x"]).withColumn("value", (F.col("value") - dark) / F.nullif(F.col("_f") / F.col("_m"), F.lit(0.0))).drop("_f", "_m")


def reference_image(df: DataFrame) -> DataFrame:
    """PX-18: (y, x, value): the mean over all images of ``df``."""
    return df.groupBy("y", "x").agg(F.avg("value").alias("value"))


def background_corrected(df: DataFrame, flat: DataFrame | None = None, dark: DataFrame | None = None, centre: float = 0.0, scale: float = 1.0) -> DataFrame:
    """PX-18: (value - dark - centre) / (scale * flat), with the images ``flat`` and ``dark`` (y, x, value) where they are given. Null where an image given has no pixel, or flat is 0."""
    top, below = F.col("value") - centre, F.lit(float(scale))
    for image, name in ((dark, "_dark"), (flat, "_flat")):
        if image is not None:
            df = df.join(image.select("y", "x", F.col("value").alias(name)), ["y", "x"], "left")
    top = top if dark is None else top - F.col("_dark")
    below = below if flat is None else below * F.col("_flat")
    return df.withColumn("value", top / F.nullif(below, F.lit(0.0))).drop("_dark", "_flat")


def inverted(df: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """PX-19: the group's maximum less each value."""
    return df.withColumn("value", F.max("value").over(Window.partitionBy(*keys)) - F.col("value"))


def remapped(df: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """PX-20: piecewise linear map through (from, to) points in rising order; constant outside."""
    v = F.col("value")
    out = F.when(v <= points[0][0], F.lit(points[0][1]))
    for (a, p), (b, q) in zip(points, points[1:], strict=False):
        out = out.when(v <= b, p + (v - a) * ((q - p) / (b - a)))
    return df.withColumn("value", out.otherwise(F.lit(points[-1][1])))


def quantised(df: DataFrame, scale: float, low: int = -128, high: int = 127) -> DataFrame:
    """PX-21: scaled whole numbers and what they read back as."""
    q = F.least(F.greatest(F.round(F.col("value") * scale), F.lit(low)), F.lit(high)).cast("int")
    return df.withColumn("stored", q).withColumn("value", F.col("stored") / scale)


def rasterised(shapes: DataFrame) -> DataFrame:
    """PX-22: pixels of boxes (xmin, xmax, ymin, ymax); with columns cx, cy, radius set, those of the disc alone."""
    px = shapes.withColumn("x", F.explode(F.sequence("xmin", "xmax"))).withColumn("y", F.explode(F.sequence("ymin", "ymax")))
    if {"cx", "cy", "radius"} <= set(shapes.columns):
        inside = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= F.col("radius") ** 2
        px = px.filter(F.coalesce(inside, F.lit(True)))
    return px


def resampled(df: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """PX-23: nearest pixel of a width x height image for each of the new grid. Each pixel is dealt to the new ones that take it, so nothing is joined."""

    def dealt(rows: DataFrame, c: str, n: int, m: int) -> DataFrame:
        # Where takers begin and end is widened by one on both sides, and the rule itself decides.
        first, last = F.greatest(F.ceil(F.col(c) * m / n - 0.5) - 1, F.lit(0)), F.least(F.ceil((F.col(c) + 1) * m / n - 0.5), F.lit(m - 1))
        rows = rows.withColumn(f"_{c}", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
        return rows.filter(F.floor((F.col(f"_{c}") + 0.5) * n / m) == F.col(c))

    rows = dealt(dealt(df.filter("frame is not null"), "y", height, to_height), "x", width, to_width)
    return rows.select("frame", F.col("_y").alias("y"), F.col("_x").alias("x"), "value")


def interpolated(grid: DataFrame, df: DataFrame, outside: float | None = None, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Values of ``df`` between pixels: each row of ``grid`` (keys, y, x, sy, sx) takes the four pixels about (sy, sx), weighed by nearness.

    Pixels that aren't there count as ``outside``, or, if that is None, not at all, and the weights of the others are
    scaled up; a place with no pixel about it has none then.
    """
    y0, x0 = F.floor("sy"), F.floor("sx")
    fy, fx = F.col("sy") - y0, F.col("sx") - x0
    corner = lambda dy, dx: F.struct((y0 + dy).cast("int").alias("y"), (x0 + dx).cast("int").alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    asked = grid.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("c"))
    asked = asked.filter("c.w > 0").select(*keys, "_y", "_x", F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.w").alias("_w"))
    met = asked.join(df.select(*keys, "y", "x", "value"), [*keys, "y", "x"], "left").groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"))
    v = F.col("value") if outside is None else F.coalesce("value", F.lit(outside))
    out = met.agg((F.sum(F.col("_w") * v) / F.sum(F.when(v.isNotNull(), F.col("_w")))).alias("value"))
    return out.filter("value is not null") if outside is None else out


def _grid(df: DataFrame, width: int, height: int, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def resampled_linear(df: DataFrame, width: int, height: int, to_width: int, to_height: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """PX-23: linear interpolation onto a new grid; pixels are taken at their middles, and border pixels go on outwards."""
    place = lambda c, n, m: F.least(F.greatest((F.col(c) + 0.5) * (n / m) - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
    grid = _grid(df, to_width, to_height, keys).withColumns({"sy": place("y", height, to_height), "sx": place("x", width, to_width)})
    return interpolated(grid, df, None, keys)


def rotated(df: DataFrame, width: int, height: int, degrees: float, outside: float = 0.0, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """PX-28: the image turned about its middle by an angle (from x towards y), interpolated linearly; what comes from beyond the image is ``outside``. Sizes stay."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    mx, my = (width - 1) / 2, (height - 1) / 2
    dx, dy = F.col("x") - mx, F.col("y") - my
    # Rounded, so that quarter turns fall on pixels.
    grid = _grid(df, width, height, keys).withColumns({"sx": F.round(mx + dx * c + dy * s, 9), "sy": F.round(my - dx * s + dy * c, 9)})
    return interpolated(grid, df, outside, keys)


def pasted(target: DataFrame, source: DataFrame) -> DataFrame:
    """PX-24: source over target."""
    return target.select(*AT, F.col("value").alias("_t")).join(source.select(*AT, F.col("value").alias("_s")), list(AT), "full").select(*AT, F.coalesce("_s", "_t").alias("value"))


def extremes(df: DataFrame, keys: Sequence[str] = ("frame",), over: float = 0.0) -> DataFrame:
    """PX-25: places of the largest and smallest value (the first in y, x of equals) and the smallest value above a threshold."""
    place = F.struct("y", "x")
    first = F.struct(F.col("value"), -F.col("y"), -F.col("x"))
    return df.groupBy(*keys).agg(
        F.max_by(place, first)["y"].alias("max_y"), F.max_by(place, first)["x"].alias("max_x"), F.max("value").alias("max"),
        F.min_by(place, F.struct("value", "y", "x"))["y"].alias("min_y"), F.min_by(place, F.struct("value", "y", "x"))["x"].alias("min_x"), F.min("value").alias("min"),
        F.min(F.when(F.col("value") > over, F.col("value"))).alias("min_over"),
    )


def kymograph(df: DataFrame, width: int, track: str = "label") -> DataFrame:
    """PX-29: frames of a track side by side along x."""
    frames = df.select(track, "frame").distinct()
    place = frames.withColumn("_k", F.row_number().over(Window.partitionBy(track).orderBy("frame")) - 1)
    return df.join(place, [track, "frame"]).select(track, "y", (F.col("x") + F.col("_k") * width).alias("x"), "value")


def contour(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PX-15: pixels of an object with one of their four neighbours outside of it."""
    near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("d")
    reached = mask.select(*keys, "y", "x", near).select(*keys, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    inside = reached.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    return mask.join(inside, [*keys, "y", "x"], "left").filter(F.coalesce("_n", F.lit(0)) < 4).drop("_n")


def components(mask: DataFrame, keys: Sequence[str] = ("frame",), low: bool = False) -> DataFrame:
    """PX-14, SR-10: connected components of the pixels of each group, with 8 neighbours or with 4 (``low``); ``object_id`` counts from 1.

    Rows of pixels are joined into runs first; only runs that touch become edges.
    """
    from lumentrack.functions.components import connected_components

    w = Window.partitionBy(*keys, "y").orderBy("x")
    runs = mask.select(*keys, "y", "x").distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    runs = runs.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = runs.withColumn("run", F.struct(*keys, "y", "x0"))
    slack = 0 if low else 1
    up = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("run").alias("dst"))
    edges = runs.join(up, [*keys, "y"]).filter((F.col("x0") - slack <= F.col("u1")) & (F.col("u0") - slack <= F.col("x1"))).select(F.col("run").alias("src"), "dst")
    named = runs.join(connected_components(edges).withColumnRenamed("node", "run"), "run", "left").withColumn("component", F.coalesce("component", "run"))
    ranked = named.withColumn("object_id", F.dense_rank().over(Window.partitionBy(*keys).orderBy("component")))
    return ranked.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(*keys, "object_id", "y", "x")

"""Training datasets: a row of arrays of one fixed shape for each object, and weights of pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.operators.pixels import contour
from lumentrack.session import written

#: What is less than this of a weight is left out of ``border_weights``.
LEAST_WEIGHT = 1e-9


def bounding_boxes(labels: DataFrame, keys: Sequence[str] = ("frame", "object_id")) -> DataFrame:
    """(keys, x0, y0, w, h) of objects by their pixels."""
    return labels.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def _padded(place: str, size: str, n: int) -> Column:
    """Where a place of a tile of ``n`` lies in a box put in its middle; below 0, or ``size`` and more, is beyond the box."""
    return F.col(place) - F.floor((F.lit(n) - F.col(size)) / 2)


def tensors(
    boxes: DataFrame, pixels: DataFrame, width: int, height: int, images: Sequence[str] = (), labels: Sequence[str] = (), *, mode: str = "pad", image_keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """SK-6, SK-12: ``boxes`` (x0, y0, w, h and any keys) with an array of width x height numbers, row by row, for each column of ``pixels`` (image_keys, y, x).

    With 'pad' a box stands in the middle of its tile (half a pixel to the left and above where it can't); around it ``images``
    repeat its border, and ``labels`` are 0. Of a larger box the middle is kept. With 'resample' it is stretched to the
    tile, images linearly, labels by the nearest pixel. Labels are 0 where there is no pixel, images null. Boxes without
    w or h or without any place in the images get such tiles, too; repeated boxes each get one. A row has width x
    height numbers a column, however large the object; the tiles' places are joined with the pixels by key, all columns at once.
    """
    if mode not in ("pad", "resample"):
        raise ValueError(f"mode {mode!r}")
    own = boxes.columns
    rows = written(boxes.withColumn("_tile", F.monotonically_increasing_id()))  # read twice, so the numbers must be kept
    places = rows.select("_tile", *image_keys, "x0", "y0", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("_at"))
    places = places.withColumns({"_i": F.floor(F.col("_at") / width), "_j": F.col("_at") % width})
    if mode == "pad":
        sy, sx = _padded("_i", "h", height), _padded("_j", "w", width)
        inside = (sy >= 0) & (sy < F.col("h")) & (sx >= 0) & (sx < F.col("w"))
        places = places.withColumns({"_sy": sy, "_sx": sx, "_label": F.coalesce(inside, F.lit(False)), "_weight": F.lit(1.0)})
    else:
        y, x = (F.col("_i") + 0.5) * F.col("h") / height - 0.5, (F.col("_j") + 0.5) * F.col("w") / width - 0.5
        places = places.withColumns({"_y": F.least(F.greatest(y, F.lit(0.0)), F.col("h") - 1.0), "_x": F.least(F.greatest(x, F.lit(0.0)), F.col("w") - 1.0)})
        corners = F.explode(F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy in (0, 1) for dx in (0, 1)]))
        places = places.withColumn("_c", corners)
        part = lambda c: F.col(f"_{c}") - F.floor(f"_{c}")
        near = lambda c: F.when(F.col(f"_c.{c}") == 1, part(c)).otherwise(1 - part(c))
        # The nearest pixel is one of the four corners; halves go up.
        closest = lambda c: (F.floor(F.col(f"_{c}") + 0.5) - F.floor(f"_{c}")) == F.col(f"_c.{c}")
        places = places.withColumns({"_weight": near("y") * near("x"), "_label": F.coalesce(closest("y") & closest("x"), F.lit(False)), "_sy": F.floor("_y") + F.col("_c.y"), "_sx": F.floor("_x") + F.col("_c.x")})
    clamped = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0)), F.col(size) - 1)
    places = places.select("_tile", *image_keys, "_at", "_label", "_weight", (F.col("y0") + clamped("_sy", "h")).alias("y"), (F.col("x0") + clamped("_sx", "w")).alias("x"))
    found = places.join(pixels.select(*image_keys, "y", "x", *images, *labels), [*image_keys, "y", "x"], "left")
    seen = lambda c: F.when(F.col(c).isNotNull() & (F.col("_weight") > 0), F.col("_weight"))
    mean = [(F.sum(F.col("_weight") * F.col(c)) / F.sum(seen(c))).alias(c) for c in images]
    nearest = [F.coalesce(F.max(F.when(F.col("_label"), F.col(c))), F.lit(0)).alias(c) for c in labels]
    cells = found.groupBy("_tile", "_at").agg(*mean, *nearest)
    tiles = cells.groupBy("_tile").agg(F.array_sort(F.collect_list(F.struct("_at", *images, *labels))).alias("_cells"))
    array = lambda c: F.transform("_cells", lambda s: s[c]).alias(c)
    return rows.join(tiles, "_tile").select(*own, *[array(c) for c in (*images, *labels)])


def _lines(ys: np.ndarray, xs: np.ndarray, reach: int, width: int, height: int) -> list[tuple[int, int, np.ndarray]]:
    """The rows (y, first x, squared distances) of the image's places in an object's box widened by ``reach``: to its nearest pixel, as far as it is no farther than that."""
    if len(ys) == 0:
        return []
    y0, x0 = (min(v.min(), max(v.min() - reach, 0)) for v in (ys, xs))
    y1, x1 = (max(v.max(), min(v.max() + reach, n - 1)) for v, n in ((ys, height), (xs, width)))
    far, at = 2 * reach + 2, np.arange(x1 - x0 + 1)
    last, following = np.full((y1 - y0 + 1, len(at)), -far), np.full((y1 - y0 + 1, len(at)), len(at) + far)
    last[ys - y0, xs - x0] = following[ys - y0, xs - x0] = xs - x0
    last, following = np.maximum.accumulate(last, axis=1), np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1]
    along = np.minimum(np.minimum(at - last, following - at), far).astype(np.int64) ** 2
    d2 = along.copy()
    for k in range(1, min(reach, len(along) - 1) + 1):
        d2[k:] = np.minimum(d2[k:], along[:-k] + k * k)
        d2[:-k] = np.minimum(d2[:-k], along[k:] + k * k)
    lo, hi = max(x0, 0), min(x1, width - 1)
    rows = range(max(y0, 0), min(y1, height - 1) + 1) if lo <= hi else ()
    return [(y, lo, d2[y - y0, lo - x0 : hi - x0 + 1].astype(np.int32)) for y in rows if d2[y - y0, lo - x0 : hi - x0 + 1].min() <= reach * reach]


def _nearest_two(starts: np.ndarray, lines: np.ndarray, reach: int, width: int) -> np.ndarray:
    """Of several objects' squared distances along a row the least at each place, then the second ones; -1 for those beyond ``reach``."""
    none = reach * reach + 1
    first, second = np.full(width, none), np.full(width, none)
    for x, d in zip(starts, lines, strict=True):
        a, b, d = first[x : x + len(d)], second[x : x + len(d)], np.minimum(d, none)
        np.minimum(b, np.maximum(a, d), out=b)
        np.minimum(a, d, out=a)
    both = np.concatenate([first, second])
    return np.where(both < none, both, -1).astype(np.int32)


def border_weights(labels: DataFrame, width: int, height: int, sigma: float, border: float, keys: Sequence[str] = ("frame",), *, object_weight: float = 0.0, erase_contours: bool = False) -> DataFrame:
    """SK-12: ``weight`` of each pixel of the images that have objects (keys, object_id, y, x), for training on their outlines.

    Pixels of objects weigh the number of other pixels over theirs, or ``object_weight`` if above 0; with
    ``erase_contours`` those at an object's edge weigh nothing. Others weigh 1, and between objects
    border exp(-(d1 + d2)^2 / (2 sigma^2)) more, by the distances to the two nearest ones; less than ``LEAST_WEIGHT``
    of it is left out, so that each object is looked at from its neighbourhood alone. An image of one object has no such part. An
    object is a row here, and of what lies about it only what is in the image is looked at; a row of the image is put together from the objects near it.
    """
    pixels = labels.select(*keys, "object_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    objects = written(pixels.groupBy(*keys, "object_id").agg(F.collect_set(F.struct("y", "x")).alias("_p")))
    grid = objects.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    # As many pixels as the objects have together: one of two objects counts twice.
    n = objects.groupBy(*keys).agg(F.sum(F.size("_p")).alias("_n"))
    reach = math.ceil(sigma * math.sqrt(2 * math.log(border / LEAST_WEIGHT))) if border > LEAST_WEIGHT else 0
    of = lambda c: F.transform(F.filter("_p", lambda v: v["y"].isNotNull() & v["x"].isNotNull()), lambda v: v[c])

    @F.pandas_udf("array<struct<y:int,x:int,d:array<int>>>")
    def lines(ys: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([_lines(y, x, reach, width, height) for y, x in zip(ys, xs, strict=True)])

    @F.pandas_udf("array<int>")
    def nearest_two(x0: pd.Series, far: pd.Series) -> pd.Series:
        return pd.Series([_nearest_two(x, d, reach, width) for x, d in zip(x0, far, strict=True)])

    near = objects.select(*keys, F.explode(lines(of("y"), of("x"))).alias("l")).select(*keys, "l.y", "l.x", "l.d")
    near = near.groupBy(*keys, "y").agg(F.collect_list(F.struct("x", "d")).alias("_l"))
    near = near.select(*keys, "y", nearest_two(F.transform("_l", lambda v: v["x"]), F.transform("_l", lambda v: v["d"])).alias("_two"))
    # First all least distances, then all second ones, squared; -1 where there is none.
    rows = grid.join(near, [*keys, "y"], "left").join(n, [*keys]).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    d2 = [F.get("_two", F.col("x") + k * width) for k in (0, 1)]
    rows = rows.select(*keys, "y", "x", "_n", *[F.when(d >= 0, F.sqrt(d)).alias(f"_d{k}") for k, d in enumerate(d2, 1)])
    extra = F.when(F.col("_d2").isNotNull(), border * F.exp(-F.pow(F.col("_d1") + F.col("_d2"), F.lit(2)) / (2 * sigma * sigma))).otherwise(0.0)
    whole = F.lit(object_weight) if object_weight > 0 else (width * height - F.col("_n")) / F.col("_n")
    weight = F.when(F.col("_d1") == 0, whole).otherwise(1 + F.coalesce(extra, F.lit(0.0)))
    if erase_contours:
        edge = contour(pixels, [*keys, "object_id"]).select(*keys, "y", "x").distinct().withColumn("_edge", F.lit(True))
        rows = rows.join(edge, [*keys, "y", "x"], "left")
        weight = F.when(F.col("_edge"), 0.0).otherwise(weight)
    return rows.select(*keys, "y", "x", weight.alias("weight"))


def track_segments(objects: DataFrame, links: DataFrame) -> DataFrame:
    """SK-6: ``objects`` (id, track, frame) with ``segment``, from 1 in each track, and ``place`` in it: a track is cut where a frame is left out or the link (src, dst) to the object before is missing. One object a track and frame is assumed."""
    w = Window.partitionBy("track").orderBy("frame", "id")
    rows = objects.withColumns({"_before": F.lag("id").over(w), "_step": F.col("frame") - F.lag("frame").over(w)})
    have = links.select(F.col("src").alias("_before"), F.col("dst").alias("id"), F.lit(True).alias("_linked")).distinct()
    rows = rows.join(have, ["_before", "id"], "left")
    starts = ~F.coalesce(F.col("_linked") & (F.col("_step") == 1), F.lit(False))
    rows = rows.withColumn("segment", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("track", "segment").orderBy("frame", "id"))).select(*objects.columns, "segment", "place")


def raw_dataset(pixels: DataFrame, frames: DataFrame, bounds: DataFrame, channels: Sequence[int], position: str = "position") -> DataFrame:
    """SK-7: (position, frame, channel, y, x, value) of the ``channels`` of the ``frames`` (position, frame) asked for, cut to each position's ``bounds`` (position, ymin, ymax, xmin, xmax, all included) and placed from there.

    Positions without bounds are left whole. Frames asked for twice come once.
    """
    rows = pixels.filter(F.col("channel").isin(list(channels))).join(frames.select(position, "frame").distinct(), [position, "frame"], "left_semi").join(bounds, position, "left")
    inside = lambda c: F.coalesce(F.col(c).between(F.col(f"{c}min"), F.col(f"{c}max")), F.lit(True))
    at = lambda c: (F.col(c) - F.coalesce(f"{c}min", F.lit(0))).alias(c)
    return rows.filter(inside("y") & inside("x")).select(position, "frame", "channel", at("y"), at("x"), "value")

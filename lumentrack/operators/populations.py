"""Populations of objects as pixel tables (keys, object_id, y, x): set algebra, gates, matches and statistics between classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.functions.components import connected_components
from lumentrack.operators.histograms import exact_percentiles, otsu
from lumentrack.operators.pixels import components, contour
from lumentrack.operators.spatial import box_pairs, container
from lumentrack.session import written

KEYS, OBJECT = ("frame",), "object_id"
#: Neighbours of a pixel: the four beside it, and the four at its corners.
SIDES, CORNERS = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (1, -1), (-1, 1), (-1, -1))


def _stepped(mask: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """A row of ``mask`` for each step, moved by it. Bounded by the number of steps."""
    d = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    return mask.withColumn("_d", d).withColumns({"y": F.col("y") + F.col("_d.dy"), "x": F.col("x") + F.col("_d.dx")}).drop("_d")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SE-4: the objects (keys, object_id) of ``a`` that share a pixel with some object of ``b``."""
    return a.join(b.select(*keys, "y", "x").distinct(), [*keys, "y", "x"], "left_semi").select(*keys, OBJECT).distinct()


def edge_contact(a: DataFrame, parents: DataFrame, keep: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """SE-5: the objects of ``a`` that touch the border of their parent's box (``keep``), or those that don't."""
    box = parents.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    on_edge = (F.col("x") == F.col("_lox")) | (F.col("x") == F.col("_hix")) | (F.col("y") == F.col("_loy")) | (F.col("y") == F.col("_hiy"))
    touch = a.join(box, list(keys)).groupBy(*keys, OBJECT).agg(F.bool_or(on_edge).alias("_touch"))
    return touch.filter(F.col("_touch") == F.lit(keep)).drop("_touch")


def combined(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-10: the pixels of ``a`` (source 0) and those of the objects of ``b`` (source 1) that overlap none of them."""
    first = a.select(*keys, F.lit(0).alias("source"), OBJECT, "y", "x")
    rest = b.join(overlapping(b, a, keys), [*keys, OBJECT], "left_anti").select(*keys, F.lit(1).alias("source"), OBJECT, "y", "x")
    return first.unionByName(rest)


def without_touching(mask: DataFrame, low: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-11: pixels with a neighbour (of four if ``low``, else of eight) of another object are erased."""
    near = _stepped(mask.select(*keys, F.col(OBJECT).alias("_o"), "y", "x"), SIDES if low else SIDES + CORNERS)
    touched = mask.select(*keys, OBJECT, "y", "x").join(near, [*keys, "y", "x"]).filter(F.col("_o") != F.col(OBJECT)).select(*keys, "y", "x").distinct()
    return mask.join(touched, [*keys, "y", "x"], "left_anti")


def extended_boxes(mask: DataFrame, by: int, parents: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-12: each object's bounding box, extended by ``by`` on each side and cut to its parent's box."""
    box = lambda df, group, p: df.groupBy(*group).agg(*[f(c).alias(f"{p}{c}{n}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))])
    both = box(mask, [*keys, OBJECT], "").join(box(parents, keys, "_"), list(keys))
    low = [F.greatest(F.col(f"{c}min") - by, F.col(f"_{c}min")).alias(f"{c}min") for c in ("x", "y")]
    return both.select(*keys, OBJECT, *low, *[F.least(F.col(f"{c}max") + by, F.col(f"_{c}max")).alias(f"{c}max") for c in ("x", "y")])


def inverted(mask: DataFrame, parents: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-13: the parents' pixels that the mask leaves out."""
    return parents.select(*keys, "y", "x").distinct().join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SE-13: each object of ``a`` less the pixels of all of ``b``; objects with none left are gone."""
    return a.select(*keys, OBJECT, "y", "x").join(b.select(*keys, "y", "x").distinct(), [*keys, "y", "x"], "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SE-13: each object of ``a`` cut to the pixels of all of ``b``; objects with none left are gone."""
    return a.select(*keys, OBJECT, "y", "x").join(b.select(*keys, "y", "x").distinct(), [*keys, "y", "x"], "left_semi")


def united(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SE-13: objects of both, those that share pixels made one, through others too: (keys, source, object_id, y, x).

    An object that one of ``a`` is part of has source 0 and the smallest of their ids, one of ``b`` alone source 1 and its own.
    """
    node = lambda side, c: F.struct(*keys, F.lit(side).alias("source"), F.col(c).alias(OBJECT))
    edges = shared(a, b, keys).select(node(0, "a").alias("src"), node(1, "b").alias("dst"))
    named = connected_components(edges).select(*[F.col(f"node.{k}").alias(k) for k in (*keys, "source", OBJECT)], F.col("component.source").alias("_s"), F.col(f"component.{OBJECT}").alias("_o"))
    both = a.select(*keys, F.lit(0).alias("source"), OBJECT, "y", "x").unionByName(b.select(*keys, F.lit(1).alias("source"), OBJECT, "y", "x"))
    rows = both.join(named, [*keys, "source", OBJECT], "left")
    return rows.select(*keys, F.coalesce("_s", "source").alias("source"), F.coalesce("_o", OBJECT).alias(OBJECT), "y", "x").distinct()


def spatial_children(parents: DataFrame, objects: DataFrame, least: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """JO-2, SR-7: (keys, parent, object_id, overlap): each object (pixels) with the parent (pixels) that it shares most pixels with, the smallest of equals; more than the share ``least`` of its own."""
    pairs = shared(objects, parents, keys).withColumnRenamed("n", "overlap")
    best = container(pairs, keys).filter(F.col("overlap") > least * F.col("size_a"))
    return best.select(*keys, F.col("b").alias("parent"), F.col("a").alias(OBJECT), "overlap")


def parents_or_overlapping(parents: DataFrame, objects: DataFrame, own: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """JO-1: (keys, object_id, parent): the parent that ``own`` (keys, object_id, parent) names, and for other objects that of largest overlap; null without either."""
    found = spatial_children(parents, objects, keys=keys).select(*keys, OBJECT, F.col("parent").alias("_p"))
    rows = objects.select(*keys, OBJECT).distinct().join(own.select(*keys, OBJECT, "parent"), [*keys, OBJECT], "left").join(found, [*keys, OBJECT], "left")
    return rows.select(*keys, OBJECT, F.coalesce("parent", "_p").alias("parent"))


def shared(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Common pixels (``n``) of each pair of objects (a, b) that has any, with both sizes."""
    size = lambda df, as_, n: df.groupBy(*keys, F.col(OBJECT).alias(as_)).agg(F.count(F.lit(1)).alias(n))
    pairs = a.select(*keys, F.col(OBJECT).alias("a"), "y", "x").join(b.select(*keys, F.col(OBJECT).alias("b"), "y", "x"), [*keys, "y", "x"])
    pairs = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(size(a, "a", "size_a"), [*keys, "a"]).join(size(b, "b", "size_b"), [*keys, "b"])


def contained(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-16: pairs (a, b) where all pixels of a lie in b."""
    return shared(a, b, keys).filter("n = size_a").select(*keys, "a", "b")


def gated(a: DataFrame, b: DataFrame, gate: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """FI-14: the pixels of each object of ``a`` together with ('a+b') or less ('a-b') those of the object of ``b`` whose box overlaps its box most, or that object's less its own ('b-a').

    Of equal overlaps the smallest id of ``b`` counts. Without an overlapping box an object stays as it is, and goes for
    'b-a'. Each object is worked on by itself, so one of ``b`` can serve several; objects without pixels left are gone.
    """
    box = lambda df: df.groupBy(*keys, OBJECT).agg(*[f(c).cast("long").alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))])
    partner = container(box_pairs(box(a), box(b), keys, name=OBJECT), keys).select(*keys, F.col("a").alias(OBJECT), F.col("b").alias("_b"))
    own = a.select(*keys, OBJECT, "y", "x")
    theirs = partner.join(b.select(*keys, F.col(OBJECT).alias("_b"), "y", "x"), [*keys, "_b"]).select(*keys, OBJECT, "y", "x")
    at = [*keys, OBJECT, "y", "x"]
    if gate == "a+b":
        return own.unionByName(theirs).distinct()
    if gate == "a-b":
        return own.join(theirs, at, "left_anti")
    if gate == "b-a":
        return theirs.join(own, at, "left_anti")
    raise ValueError(f"no such gate: {gate}")


def match_table(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ME-34: for each object of ``a`` its size, the largest and the whole overlap with ``b``, and the matched objects in order. An object has as many matches as it has pixels at most."""
    pairs = shared(a, b, keys).groupBy(*keys, F.col("a").alias(OBJECT)).agg(F.max("n").alias("overlap_max"), F.sum("n").alias("overlap_sum"), F.array_join(F.sort_array(F.collect_list("b")), "-").alias("matches"))
    sizes = a.groupBy(*keys, OBJECT).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(pairs, [*keys, OBJECT], "left").fillna(0, ["overlap_max", "overlap_sum"])


def contour_statistics(mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ME-15: mean, least and greatest value over each object's contour."""
    edge = contour(mask, [*keys, OBJECT])
    return edge.groupBy(*keys, OBJECT).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def mean_excluding(mask: DataFrame, others: DataFrame, grow: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """ME-18: each object's mean value without the pixels of ``others``, which ``grow`` dilates by their four neighbours first. Objects with no pixel left have null."""
    out = others.select(*keys, "y", "x")
    out = out.unionByName(_stepped(out, SIDES)) if grow else out
    left = mask.join(out.distinct(), [*keys, "y", "x"], "left_anti").groupBy(*keys, OBJECT).agg(F.avg("value").alias("mean"))
    return mask.select(*keys, OBJECT).distinct().join(left, [*keys, OBJECT], "left")


def relative_to(points: DataFrame, references: DataFrame, keys: Sequence[str] = KEYS, scale: float = 1.0) -> DataFrame:
    """ME-8: coordinates of each object (keys, object_id, x, y) less those of its reference (keys, x, y), scaled; null without one."""
    ref = references.select(*keys, F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    return points.join(ref, list(keys), "left").select(*keys, OBJECT, ((F.col("x") - F.col("_rx")) * scale).alias("dx"), ((F.col("y") - F.col("_ry")) * scale).alias("dy"))


# --- hierarchy by paths of indices ---


def at_level(indices: str, level: int) -> Column:
    """The first ``level`` parts of a path such as 3-1-4."""
    return F.substring_index(F.col(indices), "-", level)


def with_parent(objects: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """JO-1: each object (position, indices) with the parent (position, indices) whose path is its own cut to ``level`` parts, as ``parent``; null without one."""
    known = parents.select(F.col("position").alias("_p"), F.col("indices").alias("parent")).distinct()
    return objects.join(known, (F.col("position") == F.col("_p")) & (at_level("indices", level) == F.col("parent")), "left").drop("_p")


def child_counts(parents: DataFrame, objects: DataFrame, level: int) -> DataFrame:
    """JO-2, SR-7: the number of objects below each parent (position, indices of ``level`` parts), direct or not."""
    below = objects.groupBy("position", at_level("indices", level).alias("indices")).agg(F.count(F.lit(1)).alias("children"))
    return parents.select("position", "indices").distinct().join(below, ["position", "indices"], "left").fillna(0, ["children"])


# --- thresholds and tracks ---


def factor_of_mean(df: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    """TH-1: k times the mean value of each group."""
    return df.groupBy(*keys).agg((F.avg("value") * k).alias("threshold"))


def percentile_threshold(df: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """TH-1: the exact percentile of each group's values."""
    return exact_percentiles(df, keys, [q]).select(*keys, F.col("percentile").alias("threshold"))


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], largest: bool = True) -> DataFrame:
    """TH-6: the larger (or smaller) of two thresholds of each group."""
    both = a.join(b.withColumnRenamed("threshold", "_t"), list(keys))
    return both.select(*keys, (F.greatest if largest else F.least)("threshold", "_t").alias("threshold"))


def saturated_tracks(hist: DataFrame, pixel_share: float, object_share: float, *, keys: Sequence[str] = ("track", "object_id")) -> DataFrame:
    """TR-30: the tracks (first of ``keys``) with at least ``object_share`` of their objects saturated, from histograms (keys, bin, count).

    An object is saturated if more than ``pixel_share`` of its foreground, the pixels in bins above Otsu's, is in its last
    bin with any. An object of one value has no foreground and isn't saturated.
    """
    track = keys[0]
    used = hist.filter("count > 0")
    rows = used.join(otsu(hist, keys), list(keys), "left")
    top = F.max_by("count", "bin")
    over = F.sum(F.when(F.col("bin") > F.col("threshold_bin"), F.col("count")))
    objects = rows.groupBy(*keys).agg(F.coalesce(top > pixel_share * over, F.lit(False)).alias("_full"))
    return objects.groupBy(track).agg(F.count_if("_full").alias("_k"), F.count(F.lit(1)).alias("_n")).filter((F.col("_k") >= object_share * F.col("_n")) & (F.col("_k") > 0)).select(track)


def without_saturated(df: DataFrame, hist: DataFrame, pixel_share: float, object_share: float, *, keys: Sequence[str] = ("track", "object_id")) -> DataFrame:
    """TR-30: ``df`` less the rows of saturated tracks."""
    return df.join(saturated_tracks(hist, pixel_share, object_share, keys=keys), keys[0], "left_anti")


def border_background(image: DataFrame, corners: DataFrame, keys: Sequence[str], more_than: int = 10) -> DataFrame:
    """TR-36: (keys, y, x) of the parts of each image that have the value of one of its ``corners`` (keys, y, x) and hang together with it by sides, of more than ``more_than`` pixels."""
    seed = corners.join(image.select(*keys, "y", "x", "value"), [*keys, "y", "x"]).select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), "value")
    like = image.join(seed, [*keys, "value"]).select(*keys, "_sy", "_sx", "y", "x")
    parts = written(components(like, [*keys, "_sy", "_sx"], low=True))
    own = parts.filter("y = _sy and x = _sx").select(*keys, "_sy", "_sx", OBJECT)
    size = parts.groupBy(*keys, "_sy", "_sx", OBJECT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than).drop("_n")
    return parts.join(own.join(size, [*keys, "_sy", "_sx", OBJECT]), [*keys, "_sy", "_sx", OBJECT], "left_semi").select(*keys, "y", "x").distinct()


def without_edge_tracks(tracks: DataFrame, image: DataFrame, width: int, height: int, keys: Sequence[str], *, margin: int = 0) -> DataFrame:
    """TR-36: the pixels of ``tracks`` (keys, track, frame, y, x) less the first and the last track of each group along x that meet the background at their side.

    Tracks stand where the box of their first object has its middle, equal ones in order of track. The background is
    that of the image (keys, frame, y, x, value) of that object's frame, from its two corners on the track's side. Of objects higher
    than twice ``margin`` so much is left out at either end. One track alone is only tested on the left.
    """
    rows = tracks.select(*keys, "track", "frame", "y", "x")
    first = rows.groupBy(*keys, "track").agg(F.min("frame").alias("frame"))
    heads = rows.join(first, [*keys, "track", "frame"])
    box = heads.groupBy(*keys, "track", "frame").agg(((F.min("x") + F.max("x")) / 2).alias("_m"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    one = F.struct("track", "frame", "_y0", "_y1")
    ends = box.groupBy(*keys).agg(F.min_by(one, F.struct("_m", "track")).alias("_l"), F.max_by(one, F.struct("_m", "track")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    sides = F.array_compact(F.array(F.struct(F.lit(0).alias("side"), F.col("_l").alias("t")), F.when(F.col("_n") > 1, F.struct(F.lit(width - 1).alias("side"), F.col("_r").alias("t")))))
    asked = written(ends.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.side", "e.t.*"))
    corners = asked.select(*keys, "frame", "side", F.col("side").alias("x"), F.explode(F.array(F.lit(0), F.lit(height - 1))).alias("y")).distinct()
    views = asked.select(*keys, "frame", "side").distinct().join(image, [*keys, "frame"])
    back = border_background(views, corners, [*keys, "frame", "side"])
    cut = (F.col("_y1") - F.col("_y0") + 1 <= 2 * margin) | F.col("y").between(F.col("_y0") + margin, F.col("_y1") - margin)
    gone = heads.join(asked, [*keys, "track", "frame"]).filter(cut).join(back, [*keys, "frame", "side", "y", "x"], "left_semi").select(*keys, "track").distinct()
    return tracks.join(gone, [*keys, "track"], "left_anti")

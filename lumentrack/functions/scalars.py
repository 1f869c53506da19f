"""Scalar functions over columns: arithmetic, arrays, index paths, geometry, boxes, formatting, names. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """NaN and infinities are absent values."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def affine(value: Column, scale: float, shift: float) -> Column:
    return value * scale + shift


def roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots of a x^2 + b x + c in order, as an array; empty if there are none, one if the equation is linear."""
    d = b * b - 4 * a * c
    pair = F.sort_array(F.array((-b - F.sqrt(d)) / (2 * a), (-b + F.sqrt(d)) / (2 * a)))
    none = F.array().cast("array<double>")
    return F.when((a == 0) & (b == 0), none).when(a == 0, F.array(-c / b)).when(d < 0, none).otherwise(pair)


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmin(values: Column) -> Column:
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def array_sigma(values: Column) -> Column:
    """Population standard deviation."""
    mean = array_mean(values)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(values), F.lit(0))
    return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def array_quantile(values: Column, q: float) -> Column:
    """Linear interpolation at q (n - 1) of the sorted values."""
    ordered = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return below + (above - below) * (at - low)


def array_mad(values: Column) -> Column:
    """Median absolute deviation."""
    median = array_quantile(values, 0.5)
    return array_quantile(F.transform(values, lambda x: F.abs(x - median)), 0.5)


def linspace(start: Column, stop: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (stop - start) * i / max(n - 1, 1))


def first_where(values: Column, test) -> Column:
    """0-based place of the first element that passes, or -1."""
    return F.coalesce(F.array_min(F.filter(F.transform(values, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())), F.lit(-1))


def path_text(indices: Column) -> Column:
    return F.array_join(indices.cast("array<string>"), "-")


def path_parse(text: Column) -> Column:
    return F.split(text, "-").cast("array<int>")


def path_parent(indices: Column, levels: int = 1) -> Column:
    """The path of an ancestor; empty above the root."""
    return F.slice(indices, F.lit(1), F.greatest(F.size(indices) - levels, F.lit(0)))


def path_frame(text: Column) -> Column:
    return F.split_part(text, F.lit("-"), F.lit(1)).cast("int")


def distance2(dx: Column, dy: Column, dz: Column | None = None, ratio: float = 1.0) -> Column:
    """Squared distance; z counts ``ratio`` times."""
    flat = dx * dx + dy * dy
    return flat if dz is None else flat + dz * dz * (ratio * ratio)


def angle(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def box_volume(box: Column) -> Column:
    return (box["xmax"] - box["xmin"] + 1) * (box["ymax"] - box["ymin"] + 1)


def boxes_meet(a: Column, b: Column, slack: int = 0) -> Column:
    """Inclusive boxes share a pixel, or would with ``slack`` more on each side."""
    return (a["xmin"] - slack <= b["xmax"]) & (b["xmin"] - slack <= a["xmax"]) & (a["ymin"] - slack <= b["ymax"]) & (b["ymin"] - slack <= a["ymax"])


def box_inside(a: Column, b: Column) -> Column:
    return (a["xmin"] >= b["xmin"]) & (a["xmax"] <= b["xmax"]) & (a["ymin"] >= b["ymin"]) & (a["ymax"] <= b["ymax"])


def box_common(a: Column, b: Column) -> Column:
    """Number of pixels that two boxes share."""
    width = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]) + 1
    height = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]) + 1
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["xmin"], b["xmin"]).alias("xmin"), F.greatest(a["xmax"], b["xmax"]).alias("xmax"), F.least(a["ymin"], b["ymin"]).alias("ymin"), F.greatest(a["ymax"], b["ymax"]).alias("ymax"))


def printed(value: Column, digits: int = 5) -> Column:
    """A number rounded for export; absent values print as NA."""
    return F.coalesce(F.round(number(value), digits).cast("string"), F.lit("NA"))


def letter(n: Column) -> Column:
    """Name of the n-th lineage: capital letters without H and T, which name the daughters of a division; then letters with a count."""
    names = F.array(*[F.lit(c) for c in "ABCDEFGIJKLMNOPQRSUVWXYZ"])
    turn = F.floor(n / 24).cast("int")
    return F.concat(F.get(names, (n % 24).cast("int")), F.when(turn > 0, turn.cast("string")).otherwise(F.lit("")))

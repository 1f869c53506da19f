"""Objects to and from other programs: spots with edges, outlines, attributes and metadata as JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_metadata(df: DataFrame, json: str, attributes: str = "attributes") -> DataFrame:
    """SR-2: the map ``attributes`` (text to text) with the entries of the JSON object in the column ``json``, which win over earlier ones of their name. What isn't an object adds nothing."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(F.from_json(json, "map<string,string>"), empty)
    old = F.coalesce(F.col(attributes), empty) if attributes in df.columns else empty
    rows = df.withColumn("_new", new)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    return rows.withColumn(attributes, F.map_concat(kept, F.col("_new"))).drop("_new")


def attributes_json(attributes: str) -> Column:
    """FN-7: a map as a JSON object, its entries in order of their names; null stays null."""
    entries = F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.struct(k.alias("key"), F.element_at(attributes, k).alias("value")))
    return F.to_json(F.map_from_entries(entries))


def attributes_of(json: str) -> Column:
    """FN-7: the map in a JSON object; null where it isn't one."""
    return F.from_json(json, "map<string,string>")


def imported_spots(spots: DataFrame, parents: DataFrame, scale: float = 1.0, scale_z: float = 1.0) -> DataFrame:
    """SR-9: spots (id, frame, x, y, z, radius, quality; lengths in units) as objects of the parent of their frame, in pixels.

    ``parents`` is a parent track (parent, frame, ox, oy): what to add to a spot's place, once in pixels. Spots in frames
    without a parent are left out, as there is nothing to hang them on.
    """
    rows = spots.join(parents.select("parent", "frame", "ox", "oy"), "frame")
    return rows.select("parent", "frame", F.col("id").alias("spot"), (F.col("x") / scale + F.col("ox")).alias("x"), (F.col("y") / scale + F.col("oy")).alias("y"), (F.col("z") / scale_z).alias("z"), (F.col("radius") / scale).alias("radius"), "quality")


def matched_spots(imported: DataFrame, objects: DataFrame, limit: float) -> DataFrame:
    """SR-9: (spot, object): each imported spot with the nearest of the parent's ``objects`` (id, parent, x, y), if the square of their distance is below ``limit``.

    Of several spots with the same nearest object the nearest has it (then the smallest), the others have none, as have
    spots with nothing near: their object is null and they are new. Objects are dealt to cells as wide as the limit, so each
    spot is compared with those of nine cells only.
    """
    width = math.sqrt(limit)
    cell = lambda c, d=0: (F.floor(F.col(c) / width) + d).alias(f"_c{c}")
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    near = objects.withColumn("_d", around).select("parent", F.col("id").alias("object"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x", F.col("_d.dx")), cell("y", F.col("_d.dy")))
    far = F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2))
    pairs = imported.select("parent", "spot", "x", "y", cell("x"), cell("y")).join(near, ["parent", "_cx", "_cy"]).withColumn("_far", far).filter(F.col("_far") < limit)
    nearest = pairs.groupBy("parent", "spot").agg(F.min(F.struct("_far", "object")).alias("_n"))
    taken = nearest.groupBy("parent", F.col("_n.object").alias("object")).agg(F.min(F.struct("_n._far", "spot")).alias("_s")).select(F.col("_s.spot").alias("spot"), "object")
    return imported.select("spot").join(taken, "spot", "left")


def imported_objects(imported: DataFrame, objects: DataFrame, matches: DataFrame, *, overwrite: bool = False, track_only: bool = False) -> DataFrame:
    """SR-9: the parents' objects after the import: (id, parent, frame, x, y, spot), ids as text, those of new objects ``s`` and the spot's.

    With ``overwrite`` all objects of the parent track give way to the spots. Else a matched object stays and takes the spot's
    place, or with ``track_only`` keeps its own; unmatched ones of ``objects`` (id, parent, frame, x, y) stay without a spot
    where their parent has spots, or anywhere with ``track_only``, and go where it has none.
    """
    new = F.concat(F.lit("s"), F.col("spot").cast("string"))
    if overwrite:
        return imported.select(new.alias("id"), "parent", "frame", "x", "y", "spot")
    rows = imported.join(matches, "spot").join(objects.select(F.col("id").alias("object"), F.col("x").alias("_x"), F.col("y").alias("_y")), "object", "left")
    place = lambda c: F.when(F.col("object").isNotNull() & F.lit(track_only), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    rows = rows.select(F.coalesce(F.col("object").cast("string"), new).alias("id"), "parent", "frame", place("x"), place("y"), "spot")
    rest = objects.join(matches.select(F.col("object").alias("id")).filter("id is not null"), "id", "left_anti")
    if not track_only:
        rest = rest.join(imported.select("parent").distinct(), "parent", "left_semi")
    return rows.unionByName(rest.select(F.col("id").cast("string").alias("id"), "parent", "frame", "x", "y", F.lit(None).cast(dict(imported.dtypes)["spot"]).alias("spot")))


def imported_links(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """SR-9: links (src, dst, kind) between ``objects`` (id, frame, spot) for edges (a, b) of spots, from the earlier to the later.

    A link that is the only one of both its ends is of 'both'; of several out of an object each is 'previous', of several into
    one each 'next', and one that is both is of 'neither'. Repeated edges count once; edges within a frame or with an
    end that isn't there make no link.
    """
    end = lambda c: objects.filter("spot is not null").select(F.col("spot").alias(c), F.struct("frame", "id").alias(f"_{c}"))
    both = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b").filter("_a.frame <> _b.frame")
    rows = both.select(F.least("_a", "_b").getField("id").alias("src"), F.greatest("_a", "_b").getField("id").alias("dst")).distinct()
    split, merge = F.count(F.lit(1)).over(Window.partitionBy("src")) > 1, F.count(F.lit(1)).over(Window.partitionBy("dst")) > 1
    return rows.select("src", "dst", F.when(split & merge, "neither").when(split, "previous").when(merge, "next").otherwise("both").alias("kind"))


def exported_spots(objects: DataFrame, parents: DataFrame, scale: float = 1.0, scale_z: float = 1.0, duration: float = 1.0) -> DataFrame:
    """SK-10: spots (id, frame, time, x, y, z, radius, quality) of a parent track's objects (id, parent, frame, x, y, z, size, quality) in units: the radius is a disc's of the object's size, and parents (parent, frame, ox, oy) say what an import would add."""
    rows = objects.join(parents.select("parent", "frame", "ox", "oy"), ["parent", "frame"])
    place = lambda c: ((F.col(c) - F.col(f"o{c}")) * scale).alias(c)
    return rows.select("id", "frame", (F.col("frame") * duration).alias("time"), place("x"), place("y"), (F.col("z") * scale_z).alias("z"), (F.sqrt(F.col("size") / math.pi) * scale).alias("radius"), "quality")


def exported_edges(links: DataFrame, spots: DataFrame) -> DataFrame:
    """SK-10: edges (a, b) for links (src, dst) with both ends among ``spots``, each once."""
    has = lambda c: spots.select(F.col("id").alias(c))
    return links.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(has("a"), "a", "left_semi").join(has("b"), "b", "left_semi").distinct()


def outlined(outlines: DataFrame, keys: list[str]) -> DataFrame:
    """SR-11: pixels (keys, y, x) whose middle is inside a closed outline (keys, vertices: list of x, y), by parity, so that what an outline goes around twice is outside.

    A pixel's middle is half a pixel beyond its place. Each row of pixels has its crossings with the outline's edges in order,
    and a stretch from each odd one to the next; a middle on a left or upper edge is inside, on a right or lower one
    outside. Outlines of fewer than three vertices have no pixels. Slices of one object are rows with a key for the plane; each
    row is an outline of its own, worked off where it is.
    """

    def crossings(e: Column) -> Column:
        first, last = F.ceil(F.least(e["y0"], e["y1"]) - 0.5), F.ceil(F.greatest(e["y0"], e["y1"]) - 0.5) - 1
        at = lambda y: F.struct(y.cast("int").alias("y"), (e["x0"] + (y + 0.5 - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])).alias("x"))
        return F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), at)

    def stretches(v: Column) -> Column:
        edges = F.transform(v, lambda p, i: F.struct(p["x"].cast("double").alias("x0"), p["y"].cast("double").alias("y0"), F.element_at(v, (i + 1) % F.size(v) + 1)["x"].cast("double").alias("x1"), F.element_at(v, (i + 1) % F.size(v) + 1)["y"].cast("double").alias("y1")))
        whole = F.filter(edges, lambda e: (e["y0"] != e["y1"]) & e["x0"].isNotNull() & e["x1"].isNotNull())
        # An outline crosses each row an even number of times, so in order of row and place odd and even ones are pairs.
        lines = F.filter(F.array(F.sort_array(F.flatten(F.transform(whole, crossings)))), lambda c: F.size(c) > 1)
        return F.flatten(F.transform(lines, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2, F.lit(2)), lambda i: F.struct(F.get(c, i).alias("a"), F.get(c, i + 1).alias("b")))))

    # In lists of one, so that what is named within is worked out once.
    pairs = outlines.select(*keys, F.explode(F.flatten(F.transform(F.filter(F.array("vertices"), lambda v: v.isNotNull()), stretches))).alias("_p"))
    ends = pairs.select(*keys, F.col("_p.a.y").alias("y"), F.ceil(F.col("_p.a.x") - 0.5).alias("_f"), (F.ceil(F.col("_p.b.x") - 0.5) - 1).alias("_l")).filter("_p.a.y = _p.b.y and _f <= _l")
    return ends.select(*keys, "y", F.explode(F.sequence(F.col("_f").cast("int"), F.col("_l").cast("int"))).alias("x"))

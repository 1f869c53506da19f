"""Track operators: windows over (track, frame) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.functions.ranking import global_rank
from lumentrack.operators.histograms import exact_percentiles
from lumentrack.session import written


def _order(track: str, by: Sequence[str]):
    return Window.partitionBy(track).orderBy(*by)


def contiguous_segments(df: DataFrame, gap: int, *, track: str = "track", time: str = "secs", by: Sequence[str] = ("secs", "id")) -> DataFrame:
    """TR-5: ``segment`` numbers each track's stretches without a step above ``gap`` (gaps and islands)."""
    w = _order(track, by)
    new = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def track_measurements(df: DataFrame, *, track: str = "track", frame: str = "frame", id_col: str = "id", by: Sequence[str] = ("n",)) -> DataFrame:
    """TR-6, TR-3: length, object count, head, previous, next and whether an object is its track's head."""
    w, whole = _order(track, by), Window.partitionBy(track)
    return df.select(
        "*", (F.max(frame).over(whole) - F.min(frame).over(whole) + 1).alias("track_length"), F.count(F.lit(1)).over(whole).alias("object_count"),
        F.first(id_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"), F.lag(id_col).over(w).alias("prev_id"), F.lead(id_col).over(w).alias("next_id"), F.lag(id_col).over(w).isNull().alias("is_head"),
    )


def displacement(df: DataFrame, lags: Sequence[int], *, track: str = "track", frame: str = "n", x: str = "x", y: str = "y") -> DataFrame:
    """TR-7: for each track and lag the mean squared displacement, the mean jump and the number of pairs exactly that far apart."""
    a = df.select(F.col(track).alias("track"), F.col(frame).alias("f"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    ahead = a.select("track", "f", "x1", "y1", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("g", F.col("f") + F.col("lag"))
    b = df.select(F.col(track).alias("track"), F.col(frame).alias("g"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    d2 = (F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2
    return ahead.join(b, ["track", "g"]).groupBy("track", "lag").agg(F.avg(d2).alias("msd"), F.avg(F.sqrt(d2)).alias("mean_jump"), F.count(F.lit(1)).alias("pairs"))


def growth_rate(df: DataFrame, *, track: str = "track", time: str = "hours", size: str = "size", least: int = 3) -> DataFrame:
    """TR-8: slope of ln(size) on time since the track's start, size at its start by that line, over tracks of ``least`` rows or more. Rows of no size above 0 aren't fitted or counted."""
    t0 = df.withColumn("_t", F.col(time) - F.min(time).over(Window.partitionBy(track)))
    log = F.log(size)
    fit = t0.filter(F.col(size) > 0).groupBy(track).agg(F.regr_slope(log, "_t").alias("growth_rate"), F.exp(F.regr_intercept(log, F.col("_t"))).alias("size_at_birth"), F.count(F.lit(1)).alias("n_points"))
    enough = F.col("n_points") >= least
    return fit.select(track, F.when(enough, F.col("growth_rate")).alias("growth_rate"), F.when(enough, F.col("size_at_birth")).alias("size_at_birth"), "n_points")


def windowed_slope(df: DataFrame, half: int, *, track: str = "track", time: str = "hours", value: str = "log_size", by: Sequence[str] = ("n",)) -> DataFrame:
    """TR-8, ME-24: ``slope`` over the centred window of 2 half + 1 rows; at the ends the nearest whole window's, in short tracks that of the track.

    Rows without a value (null, NaN or infinite, as the logarithm of no size) keep their place in the window but aren't
    fitted; a window of fewer than two others has no slope.
    """
    w = _order(track, by)
    near, whole = w.rowsBetween(-half, half), Window.partitionBy(track)
    count = F.count(F.lit(1)).over(whole)
    rank = F.row_number().over(w) - 1

    def slope(over) -> Column:
        # Time is taken from the track's start, which keeps the sums of squares small.
        fitted = F.abs(value) < float("inf")
        t, v = F.when(fitted, F.col("_t")), F.when(fitted, F.col(value))
        n = F.count(t).over(over)
        num = n * F.sum(t * v).over(over) - F.sum(t).over(over) * F.sum(v).over(over)
        den = n * F.sum(t * t).over(over) - F.sum(t).over(over) ** 2
        return F.when(n > 1, num / F.nullif(den, F.lit(0.0)))

    df = df.withColumn("_t", F.col(time) - F.min(time).over(whole))
    df = df.withColumn("_i", rank).withColumn("_n", count).withColumn("_s", slope(near)).withColumn("_all", slope(whole))
    first, last = F.max(F.when(F.col("_i") == half, F.col("_s"))).over(whole), F.max(F.when(F.col("_i") == F.col("_n") - half - 1, F.col("_s"))).over(whole)
    out = F.when(F.col("_n") <= 2 * half + 1, F.col("_all")).when(F.col("_i") < half, first).when(F.col("_i") >= F.col("_n") - half, last).otherwise(F.col("_s"))
    return df.withColumn("slope", out).drop("_t", "_i", "_n", "_s", "_all")


def sliding_stats(df: DataFrame, half: int, *, track: str = "track", value: str = "x", by: Sequence[str] = ("n",)) -> DataFrame:
    """ST-15: sliding mean, sigma and median; the ends repeat the first and last whole window, short tracks have one value."""
    w, whole = _order(track, by), Window.partitionBy(track)
    near = w.rowsBetween(-half, half)
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    stats = {"mean": F.avg, "sigma": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5))}
    for name, f in stats.items():
        df = df.withColumn(f"_{name}", f(value).over(near)).withColumn(f"_all_{name}", f(value).over(whole))
    for name in stats:
        first, last = (F.max(F.when(F.col("_i") == at, F.col(f"_{name}"))).over(whole) for at in (F.lit(half), F.col("_n") - half - 1))
        out = F.when(F.col("_n") <= 2 * half + 1, F.col(f"_all_{name}")).when(F.col("_i") < half, first).when(F.col("_i") >= F.col("_n") - half, last).otherwise(F.col(f"_{name}"))
        df = df.withColumn(f"sliding_{name}", out)
    return df.drop("_i", "_n", *[f"_{n}" for n in stats], *[f"_all_{n}" for n in stats])


def divisions_ahead(df: DataFrame, division: Column, *, track: str = "track", frame: str = "frame", by: Sequence[str] = ("n",)) -> DataFrame:
    """TR-10: frames of the last division up to a row and of the next one after it."""
    w = _order(track, by)
    at = F.when(division, F.col(frame))
    return df.withColumn("next_division", F.min(at).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("previous_division", F.max(at).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def length_filter(df: DataFrame, least: int = 0, most: int = 0, *, track: str = "track") -> DataFrame:
    """TR-12, SE-6: rows of tracks with ``least`` to ``most`` objects; 0 leaves an end open."""
    n = F.count(F.lit(1)).over(Window.partitionBy(track))
    keep = (n >= least) & (F.lit(most == 0) | (n <= most))
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")


def drop_by_statistic(df: DataFrame, statistic: Column, threshold: float, *, track: str = "track", over: bool = True) -> DataFrame:
    """TR-13: tracks whose ``statistic`` (an aggregate) is above the threshold go, or below it."""
    gone = df.groupBy(F.col(track).alias("_t")).agg(statistic.alias("_s")).filter(F.col("_s") > threshold if over else F.col("_s") < threshold).select("_t")
    return df.join(gone, F.col(track) == F.col("_t"), "left_anti")


def started_by(df: DataFrame, frame_limit: int, *, track: str = "track", frame: str = "frame") -> DataFrame:
    """TR-14: tracks that start after the limit go."""
    return df.withColumn("_first", F.min(frame).over(Window.partitionBy(track))).filter(F.col("_first") <= frame_limit).drop("_first")


def ends(objects: DataFrame, parents: DataFrame, parent: Sequence[str]) -> DataFrame:
    """SE-7: objects where a track ends before or begins after its parent's.

    Both tables have ``has_previous`` and ``has_next``; ``parent`` names the columns by which an object finds its
    parent. An object stays if its parent has a next and it has none, or the parent a previous and it none.
    """
    of = parents.select(*parent, F.col("has_previous").alias("_p"), F.col("has_next").alias("_n"))
    rows = objects.join(of, list(parent))
    return rows.filter((F.col("_n") & ~F.col("has_next")) | (F.col("_p") & ~F.col("has_previous"))).drop("_p", "_n")


def fill_gaps(df: DataFrame, *, track: str = "track", frame: str = "frame", value: str = "x") -> DataFrame:
    """TR-31: every frame between a track's first and last, ``value`` interpolated, with ``filled``. One row a track and frame is assumed."""
    span = df.groupBy(track).agg(F.sequence(F.min(frame), F.max(frame)).alias("_all")).select(track, F.explode("_all").alias(frame))
    rows = span.join(df.select(track, frame, value), [track, frame], "left")
    w = Window.partitionBy(track).orderBy(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(frame))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    f0, f1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    between = F.when(f1 == f0, v0).otherwise(v0 + (v1 - v0) * (F.col(frame) - f0) / F.nullif(f1 - f0, F.lit(0)))
    return rows.select(track, frame, between.alias(value), F.col(value).isNull().alias("filled"))


def breaks(df: DataFrame, *, track: str = "track", frame: str = "frame") -> DataFrame:
    """TR-32: number of steps above one frame in each track."""
    step = F.lead(frame).over(Window.partitionBy(track).orderBy(frame)) - F.col(frame)
    return df.withColumn("_s", step).groupBy(track).agg(F.count_if(F.col("_s") > 1).alias("breaks"))


def extended(df: DataFrame, n: int, *, track: str = "track", frame: str = "frame", by: Sequence[str] = ("n",)) -> DataFrame:
    """TR-28: the last row of each track again in each of the ``n`` frames after it."""
    w = _order(track, by)
    last = df.withColumn("_last", F.lead(F.lit(1)).over(w).isNull()).filter("_last").drop("_last")
    return df.unionByName(last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(frame, F.col(frame) + F.col("_k")).drop("_k"))


def over_expression(df: DataFrame, k: float, limit: int = 3, *, track: str = "track", value: str = "x", by: Sequence[str] = ("n",)) -> DataFrame:
    """TR-34: rows of each track up to the one with its ``limit``-th value above median + k IQR of all values (the count is cumulative)."""
    quarters = exact_percentiles(df, [], [0.25, 0.5, 0.75], value)
    q = quarters.agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "percentile"))), lambda s: s["percentile"]).alias("q"))
    at = lambda i: F.get("q", F.lit(i))
    rows = df.crossJoin(F.broadcast(q)).withColumn("_over", (F.col(value) > at(1) + k * (at(2) - at(0))).cast("int"))  # one row
    before = F.sum("_over").over(_order(track, by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_n", before).filter(F.col("_n") < limit).drop("q", "_over", "_n")


def smoothed(df: DataFrame, sigma: float, half: int, *, track: str = "track", value: str = "x", by: Sequence[str] = ("n",)) -> DataFrame:
    """FN-8: Gaussian weights along a track's ordered points, renormalised at its ends."""
    w = _order(track, by)
    total, weight = F.lit(0.0), F.lit(0.0)
    for k in range(-half, half + 1):
        g = 2.718281828459045 ** (-k * k / (2 * sigma * sigma))
        v = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
        total, weight = total + F.coalesce(v * g, F.lit(0.0)), weight + F.when(v.isNotNull(), g).otherwise(0.0)
    return df.withColumn("smooth", total / F.nullif(weight, F.lit(0.0)))


# --- links ---


def link_neighbours(objects: DataFrame, links: DataFrame) -> DataFrame:
    """JO-13: each object's number of links into and out of it; more than one is a merge or a division (SE-9)."""
    out = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_next"))
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_prev"))
    both = objects.join(out, "id", "left").join(into, "id", "left")
    return both.fillna(0, ["n_next", "n_prev"]).withColumn("division", F.col("n_next") > 1).withColumn("merge", F.col("n_prev") > 1)


def connected(objects: DataFrame, links: DataFrame, merges: bool) -> DataFrame:
    """SE-9: the objects where tracks merge (more than one link into them), or else divide (more than one out of them)."""
    end = "dst" if merges else "src"
    several = links.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    return objects.join(several, "id", "left_semi")


def track_heads(objects: DataFrame, links: DataFrame) -> DataFrame:
    """TR-2: ``track_head`` of every object.

    A link (src, dst, kind) of kind 'both' is the source's next and the target's previous, and continues the track. One
    that is only the target's 'previous' (division) or the source's 'next' (merge) leaves the target the head of its
    own. An object continues one track at most; of several 'both' links into it the smallest source counts. Paths are
    shortened by doubling.
    """
    single = links.filter("kind = 'both'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
    rows = written(objects.select("id").join(single, "id", "left").select("id", F.coalesce("up", "id").alias("head")))
    while True:
        up = rows.select(F.col("id").alias("_i"), F.col("head").alias("_h"))
        rows = written(rows.join(up, F.col("head") == F.col("_i"), "left").select("id", F.coalesce("_h", "head").alias("head"), (F.coalesce("_h", "head") != F.col("head")).alias("moved")))
        if rows.filter("moved").isEmpty():
            return rows.select("id", F.col("head").alias("track_head"))
        rows = rows.drop("moved")


def split_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """TR-4: objects split by frame, position, parent, class or track (``by``): each with its ``place`` in its part, from 0 in order of ``order``, and the part's ``members``. Null is a part of its own."""
    part = Window.partitionBy(*by)
    return df.withColumns({"place": F.row_number().over(part.orderBy(*order)) - 1, "members": F.count(F.lit(1)).over(part)})


def pruned(objects: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """TR-17: objects less ``roots`` (id) and all that descends from them in time.

    Each object hangs on its first predecessor, and whether one of its ancestors goes is found by doubling, so that depth costs
    its logarithm in rounds. Further predecessors of merged objects are looked at after that; where one of these goes and
    the object doesn't yet, the doubling is done once more. Links that form a ring raise ValueError.
    """
    edges = links.select("src", "dst").filter("src is not null and dst is not null")
    up = written(edges.groupBy(F.col("dst").alias("id")).agg(F.collect_set("src").alias("ups")).withColumn("up", F.array_min("ups")))
    others = up.filter("size(ups) > 1").select("id", F.explode(F.array_except("ups", F.array("up"))).alias("src"))
    gone = written(roots.select("id").distinct())
    while True:
        # Only objects that still climb are written again; one that climbs to where there is neither such an object nor one that goes has reached its first ancestor.
        climbing, reached = written(up.select("id", "up").join(gone, "id", "left_anti")), [gone]
        for _ in range(64):
            if climbing.isEmpty():
                break
            above = climbing.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.lit(False).alias("_gone"))
            for part in reached:
                above = above.unionByName(part.select(F.col("id").alias("up"), F.lit(None).cast(up.schema["up"].dataType).alias("_up"), F.lit(True).alias("_gone")))
            moved = written(climbing.join(above, "up").select("id", F.col("_up").alias("up"), F.col("_gone").alias("gone")))
            reached.append(moved.filter("gone").select("id"))
            climbing = moved.filter("not gone").select("id", "up")
        else:
            raise ValueError("links form a ring")
        found = reached[0]
        for part in reached[1:]:
            found = found.unionByName(part)
        more = written(others.join(found.withColumnRenamed("id", "src"), "src", "left_semi").select("id").distinct().join(found, "id", "left_anti"))
        gone = written(found.unionByName(more))
        if more.isEmpty():
            return objects.join(gone, "id", "left_anti")


#: Letters of the third and further daughters of a division, by their place among them, and the sign beyond.
DAUGHTERS = "IJKLMNOPQRS"
MORE_DAUGHTERS = "-"


def lineage_labels(tracks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """TR-9, FN-9: ``lineage`` of each track (keys, track, parent, start, y), its ancestor's name and a letter for each division.

    Tracks without a parent in the table are named in order of start, y and track within ``keys``: letters without H and
    T, then letters with a count. Of a division's daughters, in order of y and track, the first adds H, the last T,
    those between I to S and then a dash, so that labels of many daughters can repeat; an only daughter adds H. A track is named after its
    ancestors by doubling: each round a track puts the letters that its ancestor has gathered before its own and takes
    over the ancestor's ancestor, so depth costs its logarithm in rounds. Parents that form a ring raise ValueError.
    """
    from lumentrack.functions.scalars import letter

    rows = tracks.select(*keys, "track", "parent", "start", "y")
    known = rows.select(*keys, F.col("track").alias("parent"), F.lit(True).alias("_known"))
    rows = rows.join(known, [*keys, "parent"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")
    born = Window.partitionBy(*keys, "parent")
    place, n = F.row_number().over(born.orderBy("y", "track")), F.count(F.lit(1)).over(born)
    middle = F.when(F.col("_i") - 1 <= len(DAUGHTERS), F.substring(F.lit(DAUGHTERS), F.col("_i") - 1, F.lit(1))).otherwise(MORE_DAUGHTERS)
    daughters = rows.filter("parent is not null").withColumns({"_i": place, "_n": n})
    daughters = daughters.select(*keys, "track", F.col("parent").alias("up"), F.when(F.col("_i") == 1, "H").when(F.col("_i") == F.col("_n"), "T").otherwise(middle).alias("letters"))
    roots = rows.filter("parent is null")
    if keys:
        roots = roots.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "y", "track")) - 1)
    else:
        roots = global_rank(roots, F.struct("start", "y", "track"), "_k")
    roots = roots.select(*keys, "track", letter(F.col("_k")).alias("name"))
    state = written(roots.select(*keys, "track", F.lit(None).cast(tracks.schema["track"].dataType).alias("up"), F.lit("").alias("letters")).unionByName(daughters))
    open_ = state.filter("up is not null").count()
    # Where all have an ancestor, ``up`` of a finished track is its root, told by the root's own null.
    while True:
        above = state.select(*keys, F.col("track").alias("up"), F.col("up").alias("_up"), F.col("letters").alias("_letters"))
        moved = state.join(above, [*keys, "up"], "left")
        further = F.col("_up").isNotNull()
        state = written(moved.select(*keys, "track", F.when(further, F.col("_up")).otherwise(F.col("up")).alias("up"), F.when(further, F.concat("_letters", "letters")).otherwise(F.col("letters")).alias("letters"), further.alias("_moved")))
        left = state.filter("_moved").count()
        state = state.drop("_moved")
        if left == 0:
            break
        if left >= open_:
            raise ValueError("tracks are their own ancestors")
        open_ = left
    named = roots.select(*keys, F.col("track").alias("up"), "name")
    return state.withColumn("up", F.coalesce("up", "track")).join(named, [*keys, "up"]).select(*keys, "track", F.concat("name", "letters").alias("lineage"))

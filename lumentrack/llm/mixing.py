"""Mixing sources to target weights by entropy balancing.

Document rates stay as near to 1 (in relative entropy) as the sources' token targets allow: the optimum tilts them
exponentially by document size, up to a cap. Newton iterations solve the convex dual, one multiplier a source, over
the table of (source, size, number of documents), which says all about the documents that the dual needs. The
rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrack.functions.ranking import global_rank
from lumentrack.llm.texts import word_count
from lumentrack.session import cut, fresh, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Rates are summed as whole multiples of 2^-20, so that the order of adding changes nothing.
GRAIN = 2**20
#: Documents of one source and size are ranked in buckets of about so many.
BUCKET_ROWS = 4096
TOLERANCE, MAX_STEPS = 1e-6, 200


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sources`` (source, total) with ``target``: by the weights in code point order (null last), none above cap x total.

    A level of target per weight is raised until the targets that it leaves below their caps take what the others can't.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = global_rank(sources, F.col("source").asc_nulls_last(), "_rank")
    ranked = cut(ranked.withColumn("_w", F.get(turn, (F.col("_rank") % len(weights)).cast("int"))).drop("_rank"))
    full = F.lit(float(cap)) * F.col("total")
    whole, level = ranked.agg(F.sum("total") * share, F.sum("_w")).first() or (None, None)
    if not whole:
        return ranked.withColumn("target", F.lit(0.0)).drop("_w")
    level = whole / level
    while True:  # each turn caps one more source at least
        capped = F.col("_w") * level >= full
        taken, rest = ranked.agg(F.coalesce(F.sum(F.when(capped, full)), F.lit(0.0)), F.sum(F.when(~capped, F.col("_w")))).first()
        if not rest or (after := (whole - taken) / rest) <= level * (1 + 1e-12):
            break
        level = after
    return ranked.withColumn("target", F.least(F.col("_w") * level, full)).drop("_w")


def balanced(cells: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Cells (key, size, docs) with ``rate``, where ``sources`` has (key, total, docs_of, target).

    Newton steps on the dual, kept inside a bracket: a source's words taken rise with its multiplier.
    """
    x = F.col("size") / F.col("scale")
    rate = lambda lam: F.least(F.exp(F.least(lam * x, F.lit(50.0))), F.lit(float(cap)))
    scale = F.greatest(F.col("total") / F.col("docs_of"), F.lit(1e-9))
    state = sources.filter("total > 0 and target > 0").select("key", "target", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (F.col("target") >= cap * F.col("total") * (1 - 1e-12)).alias("done"))
    state = cut(state)
    words = F.col("docs") * F.col("size")
    for _ in range(MAX_STEPS):
        joined = cells.join(state.filter("not done"), "key").withColumn("r", rate(F.col("lam")))
        slopes = joined.groupBy("key").agg(F.sum(words * F.col("r")).alias("got"), F.sum(F.when(F.col("r") < cap, words * x * F.col("r"))).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        # Outside the bracket: halve it, or go outwards while it is open.
        middle = F.when(lo <= -1e6, F.least(hi, F.lit(0.0)) * 2 - 1).when(hi >= 1e6, F.greatest(lo, F.lit(0.0)) * 2 + 1).otherwise((lo + hi) / 2)
        step = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise(middle)
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        after = state.join(slopes, "key", "left").select(
            "key", "target", "scale",
            F.when(F.col("done") | near, F.col("lam")).otherwise(step).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("done") | near | (hi - lo < 1e-13)).alias("done"),
        )
        state = cut(after)
        if state.filter("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"{state.filter('not done').count()} sources haven't met their targets after {MAX_STEPS} steps")
    full = F.col("target") >= cap * F.col("total") * (1 - 1e-12)
    found = sources.join(state.select("key", "scale", "lam"), "key", "left")
    rates = F.when(full, F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(rate(F.round("lam", 10)))
    return cells.join(found, "key").withColumn("rate", F.coalesce(rates, F.lit(1.0)))


def rounded(cells: DataFrame, cap: int = CAP, corrections: int = 3) -> DataFrame:
    """Cells with ``copies`` in all: systematic rounding in order of size, then single copies given or taken to meet the target."""
    part = F.round(F.col("docs") * F.col("rate") * GRAIN).cast("long")
    till = F.sum(part).over(Window.partitionBy("key").orderBy("size")) + GRAIN // 2
    copies = F.floor(till / GRAIN) - F.floor((till - part) / GRAIN)
    cells = cut(cells.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), cap * F.col("docs")).cast("long")).select("key", "size", "docs", "target", "total", "copies"))
    for _ in range(corrections):
        left = cells.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        can = F.when(F.col("left") > 0, F.col("copies") < cap * F.col("docs")).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        off = F.abs(F.abs("left") - F.col("size"))
        best = cells.join(left, "key").filter(can & (off < F.abs("left"))).groupBy("key").agg(F.min_by("size", F.struct(off, "size")).alias("size"), F.first(F.signum("left")).cast("long").alias("more"))
        cells = cut(cells.join(best, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"))
    return cells


def mix(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per row of ``docs``: doc_id, size (its words), source_size, target (its source's), taken, copies, row_key.

    Null text has no words. A null source is a source of its own. Documents without words take no part: none of
    their words can be taken, and they get one copy. Which of the documents of one source and size are copied
    follows a hash of id, source and text; rows alike in these are interchangeable. An empty table gives an empty
    result; other columns aren't read.
    """
    key = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), word_count(F.col(text)).alias("size"), row_key(id_col, source, text).alias("row_key")))
    cells = cut(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("docs"), F.first("source").alias("source")))
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("docs")).alias("total"), F.sum("docs").alias("docs_of"))
    sources = cut(targets(sources, weights, share, cap))
    cells = rounded(balanced(cells.drop("source"), sources.drop("source"), cap), cap)

    # Of a cell's documents each gets copies div docs, and the first of them in hash order one more.
    more = F.col("copies") % F.col("docs")
    n_buckets = F.ceil(F.col("docs") / BUCKET_ROWS)
    rows = rows.select("doc_id", "key", "size", "row_key", F.xxhash64("row_key").alias("h")).join(cells, ["key", "size"])
    # Written here so that nothing above the join needs a cell's rows together, and a hot cell can be split.
    rows = cut(rows.withColumn("bucket", F.pmod("h", n_buckets).cast("int")))
    filled = rows.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = rows.join(starts, ["key", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id")) + F.col("start")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("docs")) + (rank <= more).cast("int"))
    ranked = ranked.withColumn("n_copies", copies.cast("long"))
    return ranked.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * F.col("n_copies")).alias("taken"), F.col("n_copies").alias("copies"), "row_key")


def row_key(id_col: str, source: str, text: str) -> Column:
    columns = [F.col(c) for c in (id_col, source, text)]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it.

    Rows alike in id, source and text get their copies together: each as many, and the first of them one more. They
    are ranked by the task that holds them and within it, so that no task gets all of them. Such rows are looked up apart from
    the others, so that texts are shuffled once (where few rows are alike Spark broadcasts these keys).
    """
    key, n, more = (fresh(docs.columns, c) for c in ("_key", "_n", "_more"))
    picks = mix(docs, id_col=id_col, source=source, text=text, **options)
    picks = picks.groupBy(F.col("row_key").alias("_picked")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_alike")).filter("_copies > 0")
    picks = written(picks.select("_picked", F.floor(F.col("_copies") / F.col("_alike")).cast("long").alias(n), (F.col("_copies") % F.col("_alike")).alias(more)))
    picked = lambda some: docs.withColumn(key, row_key(id_col, source, text)).join(some, F.col(key) == F.col("_picked")).drop("_picked")
    rows, uneven = picked(picks.filter(F.col(more) == 0)), written(picks.filter(F.col(more) > 0))
    if not uneven.isEmpty():
        part, rank, before = (fresh(rows.columns, c) for c in ("_part", "_rank", "_before"))
        some = cut(picked(uneven).withColumn(part, F.spark_partition_id()))
        held = some.groupBy(F.col(key).alias("_k"), F.col(part).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
        held = held.withColumn(before, F.coalesce(F.sum("_m").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
        ranked = some.withColumn(rank, F.row_number().over(Window.partitionBy(key, part).orderBy(part)))
        ranked = ranked.join(held, (F.col(key) == F.col("_k")) & (F.col(part) == F.col("_p"))).drop("_k", "_p")
        ranked = ranked.withColumn(n, F.col(n) + (F.col(rank) + F.col(before) <= F.col(more)).cast("long")).drop(part, rank, before)
        rows = rows.unionByName(ranked)
    rows = rows.filter(F.col(n) > 0)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(key, n, more)

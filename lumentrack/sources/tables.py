"""The domain tables, derived from the tables at hand.

objects: line items of orders of customers, a hierarchy of three levels with index paths [frame, customer, order, idx].
tracks: events of users in order of time. pixels: embeddings as 8 x 8 images, one frame each. boxes: line items as
rectangles in a plane for each order month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, frame, cust, ord, idx, indices, size, value, quality, flag, status."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rank = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    items = items.withColumn("idx", F.row_number().over(rank) - 1)
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.select(
        F.concat(F.lit("pos"), F.col("o_custkey") % 8).alias("position"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("frame"),
        F.col("o_custkey").cast("int").alias("cust"), F.col("o_orderkey").cast("int").alias("ord"), "idx", F.col("l_quantity").cast("double").alias("size"),
        F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("quality"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    return rows.withColumn("indices", F.array("frame", "cust", "ord", "idx"))


OBJECTS_SQL = """o AS (
    SELECT 'pos' || (o_custkey % 8) AS position, (CAST(o_orderdate AS DATE) - DATE '1992-01-01')::INT AS frame,
           o_custkey::INT AS cust, o_orderkey::INT AS ord,
           (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::INT AS idx,
           l_quantity::DOUBLE AS size, l_extendedprice AS value, l_discount AS quality, l_returnflag AS flag, l_linestatus AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, frame || '-' || cust || '-' || ord || '-' || idx AS indices FROM o)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, id, kind, secs (since 2024), frame (minutes), n (0-based rank in the track), x, y."""
    events = table(spark, sf_dir, "events")
    secs = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    rows = events.select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), secs.alias("secs"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    order = Window.partitionBy("track").orderBy("secs", "id")
    return rows.withColumn("frame", F.floor(F.col("secs") / 60).cast("int")).withColumn("n", F.row_number().over(order) - 1)


TRACKS_SQL = """e AS (
    SELECT user_id AS track, event_id AS id, event_type AS kind, floor(epoch(ts) - 1704067200)::BIGINT AS secs,
           floor(floor(epoch(ts) - 1704067200) / 60)::INT AS frame,
           (row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) - 1704067200), event_id) - 1)::INT AS n,
           value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y
    FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, label, y, x, value."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("frame"), "label", F.posexplode("embedding").alias("p", "v"))
    return rows.select("frame", "label", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), F.col("v").cast("double").alias("value"))


PIXELS_SQL = """p AS (
    SELECT vec_id::INT AS frame, label, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, v::DOUBLE AS value
    FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame (order month), key, xmin, xmax, ymin, ymax: the objects as rectangles."""
    o = objects(spark, sf_dir)
    x, y = F.col("ord") * 7 % 97, (F.col("cust") * 13 + F.col("idx") * 5) % 89
    return o.select(
        F.floor(F.col("frame") / 30).cast("int").alias("frame"), F.array_join(F.col("indices").cast("array<string>"), "-").alias("key"), x.cast("int").alias("xmin"),
        (x + F.col("size") % 7).cast("int").alias("xmax"), y.cast("int").alias("ymin"), (y + F.col("size") % 5).cast("int").alias("ymax"),
    )


BOXES_SQL = (
    OBJECTS_SQL
    + """,
b AS (SELECT (frame // 30)::INT AS frame, indices AS key, (ord * 7 % 97)::INT AS xmin, (ord * 7 % 97 + size % 7)::INT AS xmax,
             ((cust * 13 + idx * 5) % 89)::INT AS ymin, ((cust * 13 + idx * 5) % 89 + size % 5)::INT AS ymax FROM k)"""
)

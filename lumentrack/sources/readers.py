"""Sources: file catalogues, selections, track tables and JSON documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def catalogue(paths: DataFrame, position: str = r"xy(\d+)", frame: str = r"t(\d+)", channel: str = r"c(\d+)") -> DataFrame:
    """SR-1: (path, position, frame, channel) out of file names, each by the first group of its pattern; absent parts are null."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return paths.select("path", part(position).alias("position"), part(frame).cast("int").alias("frame"), part(channel).cast("int").alias("channel"))


def incomplete(files: DataFrame) -> DataFrame:
    """SR-1: (position, channel, frame) that a full grid of each position's frames by all channels lacks."""
    channels = files.agg(F.collect_set("channel").alias("channel"))  # one row
    wanted = files.select("position", "frame").distinct().crossJoin(channels).withColumn("channel", F.explode("channel"))
    return wanted.join(files, ["position", "frame", "channel"], "left_anti")


def measurements(spark: SparkSession, path: str, where: str, keys: list[str], columns: list[str]) -> DataFrame:
    """SR-6: the objects of one class (``where``, as SQL) from a Parquet store with some of their measurements; both reach the scan. Measurements that the store lacks are null, and those named twice or among the keys come once."""
    rows = spark.read.parquet(path).filter(where)
    names = [*dict.fromkeys([*keys, *columns])]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in names])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, sizes and times of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def selections_csv(spark: SparkSession, path: str) -> DataFrame:
    """SR-4: (name, oc, position, indices) of a table with the columns Position;ObjectClassIdx;Indices;SelectionName."""
    rows = spark.read.csv(path, sep=";", header=True)
    return rows.select(F.col("SelectionName").alias("name"), F.col("ObjectClassIdx").cast("int").alias("oc"), F.col("Position").alias("position"), F.col("Indices").alias("indices"))


def mixed_classes(selections: DataFrame) -> DataFrame:
    """SR-4: names of selections whose members are of several classes, which is an error."""
    return selections.groupBy("name").agg(F.count_distinct("oc").alias("classes")).filter("classes > 1")


def selections_json(spark: SparkSession, path: str) -> DataFrame:
    """SR-5: the same from JSON lines {name, objectClassIdx (or structureIdx), objects: {position: [indices]}}."""
    schema = "name string, objectClassIdx int, structureIdx int, objects map<string, array<string>>"
    rows = spark.read.schema(schema).json(path)
    members = rows.select("name", F.coalesce("objectClassIdx", "structureIdx").alias("oc"), F.explode("objects").alias("position", "_i"))
    return members.select("name", "oc", "position", F.explode("_i").alias("indices"))


def documents_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SR-12: rows of JSON lines, and apart from them the lines that don't parse."""
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_parse_json(value)").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*"), parsed.filter("not ok").select(F.col("value").alias("line"))


def track_table(spark: SparkSession, path: str) -> DataFrame:
    """SR-8: (label, begin, end, parent) of a text file of four columns; parent 0 is none."""
    rows = spark.read.csv(path, sep=" ", schema="label int, begin int, end int, parent int")
    return rows.withColumn("parent", F.nullif("parent", F.lit(0)))


def links_of_labels(objects: DataFrame, table: DataFrame) -> DataFrame:
    """SR-8: links (src, dst, kind) of objects (id, label, frame): within a label in order of frames, and from a parent's last object to a child's first."""
    w = Window.partitionBy("label").orderBy("frame")
    within = objects.select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), F.lit("track").alias("kind")).filter("src is not null")
    last = objects.groupBy(F.col("label").alias("parent")).agg(F.max_by("id", "frame").alias("src"))
    first = objects.groupBy("label").agg(F.min_by("id", "frame").alias("dst"))
    division = table.filter("parent is not null").join(last, "parent").join(first, "label").select("src", "dst", F.lit("division").alias("kind"))
    return within.unionByName(division)


def regions(labels: DataFrame, keys: list[str]) -> DataFrame:
    """SR-10: bounds and size of each label above 0, with the labels counted anew from 1."""
    found = labels.filter("label > 0").groupBy(*keys, "label").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count(F.lit(1)).alias("size"))
    return found.withColumn("new_label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("label")))

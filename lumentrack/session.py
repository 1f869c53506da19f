"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode with the setting unset, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    Unlike a checkpoint's, its true size is known to the planner, which broadcasts it only below
    spark.sql.autoBroadcastJoinThreshold; and what was known of the rows that it was made from is forgotten, which
    in loops would otherwise grow from turn to turn until planning takes longer than running.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column of ``taken`` bears it (case is ignored, as Spark does)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name

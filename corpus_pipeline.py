"""A corpus pipeline over documents: language, exact copies, near copies, mix of sources, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumentrack.llm import bpe, exact_dedup, langid, mixing, near_dedup
from lumentrack.session import ensure_checkpoint_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those in none of the learnt languages, go.

    Repeated rows share their fate; where two languages are as near, the first in code point order is taken. Very long
    texts are read whole. With no labelled language nothing stays, and an empty table stays empty.
    """
    return langid.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest id stays.

    Rows that repeat id and text all stay; null ids go where a text has another id. An empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the largest id stays.

    Texts without words are near no other but their equals. Rows that repeat id and text share their fate; null ids go
    where a class has another id. An empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until each source's words meet its target.

    A null source is a source; documents without words stay once. Of ties a hash decides, the same on each run. Rows
    alike in id, source and text share their copies. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests by document; repeated rows each have one. Null texts count as empty. An empty table stays empty."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, sampled sketches and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs

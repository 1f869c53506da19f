"""Exact deduplication of documents through recipes of content-defined chunks.

A text is cut where its own content says so, each chunk gets an identifier, and a document becomes the
ordered list of its chunks' identifiers. Chunk texts move once, to verify the identifiers; from then on
only the short lists move. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.functions.slots import marked, slots
from lumentrack.session import cut, fresh, written

#: A chunk ends after one word in so many, as a hash of it and the next one has it, and has at most MAX_WORDS.
WORDS, MAX_WORDS = 96, 1024
#: Java pattern whose matches tile a text: words with the white space after them. What runs on without white space is
#: parted after the first vowel, low digit or punctuation mark, or where it has none of these, after 256 characters.
WORD_PATTERN = r"(?s)\S{0,255}\s{1,256}|\S{1,255}\z|\S{0,255}?[aeiouAEIOU0-4\p{P}]|.{1,256}"


def with_chunks(rows: DataFrame, name: str, *, text: str = "text", words: int = WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """``rows`` with the array ``name`` of the text's chunks in order (null has none), in a chain of projections.

    Whether a chunk ends between two words depends on these two alone. So an edit changes the chunks about it, and
    those before and after stay as they are; only stretches of more than ``max_words`` words without an end are
    counted out from where they begin.
    """
    w, h, e = (fresh([*rows.columns, name], c) for c in ("_words", "_hashes", "_ends"))
    step = rows.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN), F.lit(0)))
    step = step.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    ends = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(words)) == 0)
    step = step.withColumn(e, F.filter(F.transform(ends, lambda end, i: F.when(end & (i + 1 < F.size(w)), i + 1)), lambda i: i.isNotNull())).drop(h)
    stretches = F.zip_with(F.concat(F.array(F.lit(0)), e), F.concat(e, F.array(F.size(w))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = F.flatten(F.transform(stretches, lambda s: F.transform(F.sequence(s["a"], s["b"] - 1, F.lit(max_words)), lambda a: F.struct(a.alias("a"), F.least(a + max_words, s["b"]).alias("b")))))
    chunks = F.transform(parts, lambda s: F.array_join(F.slice(w, s["a"] + 1, s["b"] - s["a"]), ""))
    return step.withColumn(name, F.when(F.size(w) > 0, chunks).otherwise(F.array().cast("array<string>"))).drop(w, e)


def identifier(chunk: Column) -> Column:
    """128 bits of a chunk, by two differently seeded hashes."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(7), chunk).alias("b"))


def shared_identifiers(chunked: DataFrame, identify: Callable[[Column], Column] = identifier) -> DataFrame:
    """Identifiers (column ``id``) that stand for two or more different texts in ``chunks``: the dictionary's collisions.

    Equal chunks are combined before the shuffle, so a passage that many documents share moves once per task.
    """
    entries = chunked.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
    return entries.groupBy("id").count().filter("count > 1").select("id")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", identify: Callable[[Column], Column] = identifier) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the largest doc_id stays. Null text counts as empty, and all
    empty texts are equal. Rows that repeat both id and text carry the same verdict. Null ids are ignored when the
    id that stays is chosen; a group with no other id keeps its null ids. Other columns of ``docs`` are not read,
    whatever their names. An empty table gives an empty result.

    Lists of verified identifiers are compared. Should an identifier stand for different chunks, the documents
    whose lists hold it are compared by their whole texts instead.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Texts are cut once, and written: the dictionary and the lists are both made from that table.
    chunked = written(with_chunks(rows, "chunks").select("doc_id", "chunks", F.sha2("text", 256).alias("text_sha256")))
    collisions = cut(shared_identifiers(chunked, identify))
    recipe = F.transform("chunks", identify)
    listed = cut(chunked.select("doc_id", recipe.alias("recipe"), "text_sha256"))
    groups = listed.groupBy(F.col("recipe").alias("of")).agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Joined on length and list, both sides are exchanged for the join alone, so that a hot list can be split at run time.
    same = (F.size("recipe") == F.size("of")) & (F.col("recipe") == F.col("of"))
    out = listed.join(groups, same, "left").drop("of")
    if not collisions.isEmpty():
        doubtful = groups.select(F.col("of").alias("recipe"), F.explode("of").alias("id")).join(collisions, "id", "left_semi").select("recipe").distinct()
        texts = chunked.select("doc_id", F.array_join("chunks", "").alias("text"), recipe.alias("recipe"), "text_sha256").join(doubtful, "recipe", "left_semi")
        whole = texts.groupBy("recipe", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
        again = texts.join(whole, ["recipe", "text"]).select("doc_id", "recipe", "text_sha256", "top", "n")
        out = out.join(doubtful, "recipe", "left_anti").unionByName(again)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, less the rows whose text a row with a larger id repeats.

    Rows that repeat both id and text all stay, as do null ids of a group that has no other. ``docs`` is read once more
    against the dropped ids and text digests: rows whose id isn't in a dropped one's slot stay where they are, only the others move.
    """
    digest, may = fresh(docs.columns, "_digest"), fresh(docs.columns, "_may")
    dropped = exact_groups(docs, id_col=id_col, text=text).filter(~F.col("kept"))
    dropped = written(dropped.select(F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_digest")).distinct())
    split = marked(docs, slots(dropped, "_drop_id"), id_col, may)
    rows = split.filter(may).drop(may).withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    gone = rows[id_col].eqNullSafe(dropped["_drop_id"]) & (rows[digest] == dropped["_drop_digest"])
    return split.filter(~F.col(may)).drop(may).union(rows.join(dropped, gone, "left_anti").drop(digest))

"""Which rows of a large table can have a key of another one, told by a bounded table of bits, so that all others stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.session import fresh, written

#: Slots that keys fall into by a hash; 64 of them are a row of the table of bits.
SLOTS = 2**23


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def slots(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): the slots that the keys fall into, in SLOTS / 64 rows at most, however many keys there are."""
    rows = keys.select(_slot(F.col(key)).alias("_s"))
    bits = F.expr("bit_or(shiftleft(1L, cast(_s % 64 AS int)))")
    return written(rows.groupBy(F.floor(F.col("_s") / 64).alias("_word")).agg(bits.alias("_bits")))


def marked(rows: DataFrame, taken: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where no key has the slot of ``key``.

    ``taken`` is of ``slots``; it is broadcast, as its size is bounded. With far more keys than slots more rows are true.
    """
    s, word, bits = (fresh([*rows.columns, name], c) for c in ("_slot", "_word", "_bits"))
    taken = F.broadcast(taken.select(F.col("_word").alias(word), F.col("_bits").alias(bits)))
    found = rows.withColumn(s, _slot(rows[key])).withColumn(word, F.floor(F.col(s) / 64)).join(taken, word, "left")
    set_ = F.getbit(bits, (F.col(s) % 64).cast("int")) == 1
    return found.withColumn(name, F.coalesce(set_, F.lit(False))).select(*[found[c] for c in rows.columns], name)

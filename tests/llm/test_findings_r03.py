"""Findings of round 3 on the training-data operators: memory and work of single steps."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from pyspark.sql import functions as F

from lumentrack.functions import slots
from lumentrack.llm import bpe, exact_dedup, langid, near_dedup


def test_symbols_take_little_more_memory_than_texts():
    rng = random.Random(1)
    words = ["über", "naïve", "año", "word", "x", "Straße,", "1.", "日本"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randrange(400))) for _ in range(6000))]
    batch = pa.array(texts, pa.string())
    langid.symbols(batch.slice(0, 10))  # makes the table
    tracemalloc.start()
    s, at = langid.symbols(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 4 * langid.SYMBOL_BYTES and peak < 8 * batch.nbytes
    for i in (0, 1, 2, 999, 6001):
        assert s[at[i] : at[i + 1]].tolist() == langid.symbols(batch.slice(i, 1))[0].tolist()
    assert [v.tolist() for v in langid.symbols(batch.slice(0, 0))] == [[], [0]]


def test_new_pieces_are_looked_up_without_searching_for_their_last_bytes(monkeypatch):
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    pieces = {"".join(rng.choices("abcdeinorstu éß'#", k=rng.randrange(1, 14))) for _ in range(3000)}
    sought, search = [], np.searchsorted

    def counting(a, b, *more):
        sought.append(np.size(b) if len(a) == len(v.edges) else 0)
        return search(a, b, *more)

    monkeypatch.setattr(np, "searchsorted", counting)
    found = v.learn(set(pieces))
    assert sum(sought) < 2 * sum(len(p.encode()) for p in pieces)
    monkeypatch.undo()
    for p in sorted(pieces)[::10]:
        assert np.frombuffer(found[p], "<u4").tolist() == v.merged(p.encode())


def joined_by_shuffle(df):
    """Whether the first of the tables that ``df`` is a union of is joined by a shuffle."""
    plan = df._jdf.queryExecution().sparkPlan()
    return plan.nodeName() != "Union" or "SortMergeJoin" in plan.children().head().toString()


def test_texts_without_a_copy_do_not_move(spark, monkeypatch):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    texts = [words(k) for k in range(400)]
    rows = [*enumerate(texts), (400, texts[3]), (401, texts[5] + " end"), (402, texts[5] + " end"), (None, texts[7]), (None, None), (5, texts[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_slot", F.lit(1)).cache()
    before, moved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def counting(of, taken, key, name):
        out = slots.marked(of, taken, key, name)
        moved.append(out.filter(name).count())
        return out

    try:
        for module in (exact_dedup, near_dedup):
            monkeypatch.setattr(module, "marked", counting)
        exact, near = exact_dedup.drop_copies(df), near_dedup.one_of_each(df)
        assert not joined_by_shuffle(exact) and not joined_by_shuffle(near)
        assert moved and max(moved) < 20
        left = Counter((r.doc_id, r.text) for r in exact.collect())
        assert left == Counter(r for r in rows if r not in ((3, texts[3]), (401, texts[5] + " end"), (None, texts[7]), (5, texts[9])))
        assert exact.columns == near.columns == df.columns
        gone = {(3, texts[3]), (5, texts[5]), (401, texts[5] + " end"), (None, texts[7]), (5, texts[9])}
        assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter(r for r in rows if r not in gone)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_keys_than_slots_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(slots, "SLOTS", 128)
    keys, rows = spark.range(0, 3000, 3).withColumnRenamed("id", "k"), spark.range(2000)
    out = slots.marked(rows, slots.slots(keys, "k"), "id", "may")
    assert out.count() == 2000 and out.filter("not may and id % 3 = 0").count() == 0
    monkeypatch.setattr(slots, "SLOTS", 2**23)
    assert slots.marked(rows, slots.slots(keys, "k"), "id", "may").filter("may and id % 3 <> 0").count() < 20
    assert slots.marked(rows, slots.slots(keys.limit(0), "k"), "id", "may").filter("may").count() == 0


def test_language_passes_each_text_once(spark):
    word = lambda k, n: " ".join(f"{k}{chr(97 + i % 7)}" for i in range(n))
    rows = [(i, None if i % 9 == 0 else word("ab" if i % 2 else "xy", 30 + i), "u" if i % 2 else "v", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = langid.accepted(df)
    python = out._jdf.queryExecution().analyzed().toString()
    assert "_text" not in python and out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[1] is not None]

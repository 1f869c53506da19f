"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumentrack.llm import bpe, exact_dedup, langid, mixing, near_dedup, packing, quality_pu, quality_rules, queries, sharding, texts, warc
from tools.compare import TABLES, canonical

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard string, _key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(*texts_, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None, "x", "y", "z") for i, t in enumerate(texts_)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 700} the of" for i in range(12_000))
    rows = rows_of(None, "", "  \n ", "same text here", "same text here", long, long + " end", "é" * 5000, "#" * 4000, "a\nb\na\n\n", "\x1c\x85 odd　spaces")
    rows += [rows[3], (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None), (99, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = canonical(queries.QUERIES[name](spark, SF).toPandas()), canonical(con.sql(queries.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


# --- exact dedup ---


def test_chunks_tile_the_text(spark, odd):
    assert exact_dedup.with_chunks(odd, "keep_id2").filter(F.array_join("keep_id2", "") != F.coalesce("text", F.lit(""))).count() == 0
    long = spark.createDataFrame(rows_of("the " * 9000, "x" * 3000, " " * 3000, "\u00e9\U0001f600" * 700), SCHEMA)
    got = exact_dedup.with_chunks(long, "chunks", max_words=3).collect()
    assert all("".join(r.chunks) == r.text and len(r.chunks) > 1 for r in got)


def test_chunks_are_the_same_again_after_an_insertion(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    prose = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    lines = prose.replace(" q", "\nq")
    solid = "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(40_000))
    for t in (prose, lines, solid):
        edited = ["x" + t, t[:9000] + " some words between " + t[9000:], t[:5000] + t[5001:]]
        of, *others = (r.chunks for r in exact_dedup.with_chunks(spark.createDataFrame(rows_of(t, *edited), SCHEMA), "chunks").orderBy("doc_id").collect())
        assert len(of) > 30 and all(len(set(of) & set(o)) >= len(of) - 3 for o in others)


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        keep = lambda i: i if len(ids) == 1 else top
        out += [(i, keep(i), len(ids), i == keep(i), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_exact_groups(odd, none):
    assert Counter(map(tuple, exact_dedup.exact_groups(odd).collect())) == brute_groups(odd.collect())
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_groups_with_colliding_identifiers(odd):
    """A bad hash gives many chunks one identifier: results stay exact."""
    weak = lambda c: F.struct((F.length(c) % 2).alias("a"))
    assert Counter(map(tuple, exact_dedup.exact_groups(odd, identify=weak).collect())) == brute_groups(odd.collect())


def test_drop_copies(odd, none):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[4] == 1 and ids[3] == 0 and ids[99] == 1 and ids[0] == ids[1] == 0 and ids[None] == 2
    assert exact_dedup.drop_copies(none).count() == 0


# --- mixing ---


def test_mix(spark, docs, odd, none):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))
    want = Counter()
    for r in docs.collect():
        want[r.source] += len(WORD.findall(r.text))
    by = {s: i for i, s in enumerate(sorted(want))}
    source = {r.doc_id: r.source for r in docs.collect()}
    got, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        s = source[r.doc_id]
        assert r.source_size == want[s]
        got[s] += r.taken
        target[s] = r.target
    weight = {s: (3, 1, 2)[i % 3] for s, i in by.items()}
    left, budget, expect = set(want), 1.5 * sum(want.values()), {}
    while True:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * want[s]}
        if not full:
            break
        for s in full:
            expect[s] = 2.0 * want[s]
            budget -= expect[s]
        left -= full
    expect |= {s: level * weight[s] for s in left}
    assert all(abs(target[s] - expect[s]) < 1e-6 * expect[s] for s in want)
    assert all(abs(got[s] - target[s]) < 0.02 * target[s] for s in want)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_rates_are_exponentially_tilted(spark):
    cells = spark.createDataFrame([("k", s, 10) for s in (5, 10, 20, 40)], "key string, size long, docs long")
    total = 10 * 75
    for target in (300.0, 900.0):
        sources = spark.createDataFrame([("k", total, 40, target)], "key string, total long, docs_of long, target double")
        rows = mixing.balanced(cells, sources).collect()
        assert abs(sum(r.docs * r.size * r.rate for r in rows) - target) < 1e-4 * target
        tilt = {round(np.log(r.rate) / r.size, 8) for r in rows if r.rate < 2}
        assert len(tilt) == 1


def test_alike_rows_share_their_copies(spark):
    """Rows alike in id, source and text take the words of the mix, not a rounded mean of their copies."""
    rows = [(1, "one two three four", "a", f"extra {i}") for i in range(50)] + [(2, "five six", "b", "x"), (None, None, None, None), (3, "a b c d e f g h", "b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n string").repartition(5)
    taken = {r.source: r.n for r in mixing.mix(df).join(df.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += len(WORD.findall(r.text or ""))
    assert got["a"] == taken["a"] and got["b"] == taken["b"] and max(Counter(r._n for r in out.collect() if r.source == "a").values()) <= 2


# --- revisits ---


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    records = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        url = rng.choice(["http://A.com:80/x/?b=1&a=2#f", "https://a.com/x?a=2&b=1&utm_source=q", "http://b.org/", None])
        tag = rng.choice(['"1"', 'W/"1"', '"2"', None])
        records.append((f"r{i:03}", url, rng.choice([None, rng.randrange(400_000)]), kind, 200 if kind == "response" else 304, tag, rng.choice(["m", None]), {"ETag": tag or "", "X": str(i), "Content-Length": str(i)}, f"d{i}" if kind == "response" else None, "clash"))
    df = spark.createDataFrame(records, "record_id string, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload_digest string, canonical_url string")
    canon = lambda u: None if u is None else "b.org" if "b.org" in u else "a.com/x?a=2&b=1"
    got = {r.record_id: r for r in warc.resolve_revisits(df, bucket_seconds=50_000).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in records)
    for rid, url, ts, kind, _, tag, date, headers, _, _ in records:
        if kind == "response":
            continue
        before = [r for r in records if r[3] == "response" and url and ts is not None and r[2] is not None and canon(r[1]) == canon(url) and r[2] < ts]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            verdict = "no_response"
        elif tag and best[5]:
            verdict = "resolved" if tag.removeprefix("W/") == best[5].removeprefix("W/") else "validator_mismatch"
        else:
            verdict = "resolved" if date and best[6] else "no_validator"
        g = got[rid]
        assert (g.verdict, g.response_id) == (verdict, best and best[0])
        if verdict == "resolved":
            assert g.payload_digest == best[8] and g.headers == {"etag": headers["ETag"], "x": headers["X"], "content-length": best[7]["Content-Length"]}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# --- near dedup ---


def near_fixture():
    rng = random.Random(8)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    common = make(30)
    out, base = [], make(200)
    for _ in range(60):  # a large group of near copies
        t = list(base)
        t[rng.randrange(200)] = "edit%d" % rng.randrange(10**6)
        out.append(t)
    for _ in range(40):
        t = common + make(rng.randrange(30, 200))  # a passage that many share
        out.append(t)
        if rng.random() < 0.4:
            u = list(t)
            u[-1] = "other"
            out.append(u)
    return [" ".join(t) for t in out] + ["one two", "one two", "", None, "one"]


def plain_similarity(lines):
    """Weighted Jaccard similarity of all pairs, from the definition: count x ln(1 + texts / texts with the shingle), the ratio 16 at most."""
    bags = []
    for t in lines:
        w = WORD.findall(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    texts_with = Counter(s for t in set(lines) for s in bags[lines.index(t)]) if len(lines) < 1000 else Counter(s for b in bags for s in b)
    n = len(set(lines))
    column = {s: i for i, s in enumerate(s for s, k in texts_with.items() if k > 1 or len(lines) < 1000)}
    idf = {s: np.log1p(min(n / k, 16)) for s, k in texts_with.items()}
    whole = np.array([sum(k * idf[s] for s, k in b.items()) for b in bags])
    has = np.zeros((len(lines), max(1, len(column))))
    for i, b in enumerate(bags):
        for s, k in b.items():
            if s in column:
                has[i, column[s]] = k * idf[s]
    common = np.zeros((len(lines), len(lines)))
    if max((k for b in bags for k in b.values()), default=1) == 1:  # then the smaller of two weights is their root product
        has = np.sqrt(has)
        common = has @ has.T
    else:
        for i in range(len(lines)):
            common[i] = np.minimum(has[i], has).sum(axis=1)
    return common / np.maximum(whole[:, None] + whole[None, :] - common, 1e-12)


def components_of(links):
    np.fill_diagonal(links, True)
    name = np.arange(len(links))
    while True:
        new = np.array([name[row].min() for row in links])
        new = new[new]
        if (new == name).all():
            return name
        name = new


def test_five_thousand_near_copies(spark):
    """A large group of copies with few to many edits, and chains whose ends aren't alike: no link is lost."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(400)]
    body = []
    for i in range(4600):
        t = list(base)
        for k in range(rng.choice((0, 0, 0, 1, 1, 2, 8))):
            t[rng.randrange(len(t))] = f"e{i}x{k}"
        body.append(" ".join(t) + f" end{i}")
    for chain in range(20):  # each link moves on by a few words
        for step in range(20):
            body.append(" ".join(f"c{chain}w{k}" for k in range(4 * step, 4 * step + 80)))
    body = list(dict.fromkeys(body))
    name = components_of(plain_similarity(body) >= 0.8 - 1e-9)
    got = np.array([r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows_of(*body), SCHEMA)).orderBy("doc_id").collect()])
    sizes = np.bincount(name)
    assert sizes.max() > 2000 and (sizes == 1).sum() > 300 and (sizes == 20).sum() == 20
    want = {}
    for i, c in enumerate(name.tolist()):
        want[c] = max(want.get(c, 0), i)
    assert got.tolist() == [want[c] for c in name.tolist()]


def test_near_classes_against_brute_force(spark):
    body = near_fixture()
    df = spark.createDataFrame(rows_of(*body), SCHEMA)
    got = {r.doc_id: r for r in near_dedup.near_classes(df).collect()}
    assert len(got) == len(body)
    lines = [t or "" for t in body]
    sims = plain_similarity(lines)
    parent = list(range(len(body)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(body)):
        others = list(range(i + 1, len(body)))
        if others:
            for j in others:
                if sims[i, j] >= 0.8 or lines[i] == lines[j]:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(body)):
        groups[find(i)].append(i)
    for ids in groups.values():
        assert {got[i].class_id for i in ids} == {max(ids)} and {got[i].class_size for i in ids} == {len(ids)}
        assert [i for i in ids if got[i].kept] == [max(ids)]


def test_near_pairs_among_many_unlike_templates(spark):
    """2,000 texts about 0.73 alike fill large buckets; pairs about 0.81 alike must all be found among them."""
    n = 2000
    common = [f"c{i}" for i in range(400)]
    body = []
    for i in range(n):
        pair = i // 2 if i < 400 else i  # the first 400 texts are 200 pairs
        body.append(" ".join([*common, *[f"p{pair}x{k}" for k in range(6)], *[f"o{i}x{k}" for k in range(12)]]))
    s, count, at = near_dedup.counted(pa.array(body))
    assert (count == 1).all()
    values, column, having = np.unique(s, return_inverse=True, return_counts=True)
    shared = having > 1  # shingles of one text count for its weight alone
    w = np.exp(near_dedup.Weights(n, list(zip(values[having * near_dedup.IDF_CEILING >= n].tolist(), having[having * near_dedup.IDF_CEILING >= n].tolist(), strict=True))).levels(s, count) * 0.02)
    row = np.repeat(np.arange(n), np.diff(at))
    place, both = np.cumsum(shared) - 1, shared[column]
    has = np.zeros((n, shared.sum()), np.float32)
    has[row[both], place[column[both]]] = np.sqrt(w[both])
    in_common, whole = has @ has.T, np.bincount(row, w, n)
    sim = in_common / (whole[:, None] + whole[None, :] - in_common)
    near = {(int(a), int(b)) for a, b in np.argwhere(sim >= 0.8) if a < b}
    assert near == {(i, i + 1) for i in range(0, 400, 2)} and np.median(sim) > 0.7
    got = near_dedup.near_classes(spark.createDataFrame(rows_of(*body), SCHEMA)).collect()
    found = defaultdict(list)
    for r in got:
        found[r.class_id].append(r.doc_id)
    assert {tuple(sorted(ids)) for ids in found.values() if len(ids) > 1} == near


def test_copies_of_a_text_leave_its_near_copies_near(spark):
    """A text has nine tenths of all rows. Its near copies are linked as they are with one row of each text."""
    hot = [f"h{i}" for i in range(200)]
    near = [" ".join(hot[:at] + ["edit"] + hot[at + 1 :]) for at in (50, 150)]
    others = [" ".join(f"o{i}x{k}" for k in range(60)) for i in range(37)]
    for copies in (1, 360):
        df = spark.createDataFrame(rows_of(*others, *near, *[" ".join(hot)] * copies), SCHEMA)
        got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_classes(df).collect()}
        assert {got[i] for i in range(37, 39 + copies)} == {(38 + copies, 2 + copies)}
        assert all(got[i] == (i, 1) for i in range(37))


def test_common_shingles_are_counted_exactly(spark, docs):
    texts_ = docs.select("text").repartition(5)
    counts = Counter()
    for r in texts_.collect():
        counts.update(set(near_dedup.counted(pa.array([r.text]))[0].tolist()))
    n = docs.count()
    assert dict(near_dedup.common_shingles(texts_)) == {h: c for h, c in counts.items() if c * near_dedup.IDF_CEILING >= n}


def test_agreement_estimates_weighted_jaccard():
    rng = random.Random(1)
    a = [f"w{rng.randrange(400)}" for _ in range(900)]
    b = a[:600] + [f"v{i}" for i in range(250)]
    pair, w = pa.array([" ".join(a), " ".join(b)]), near_dedup.Weights(100, [])
    s, n, at = near_dedup.counted(pair)
    x, y = near_dedup.Sampler(2000).sketches(s, w.levels(s, n), at)
    assert abs((x == y).mean() - near_dedup.jaccard(pair[:1], pair[1:], w)[0]) < 0.05


@pytest.mark.parametrize("counts", [None, 5])
def test_similar_texts_share_a_prefix_shingle(spark, monkeypatch, counts):
    """Whatever the order is, here by counts of slots or, with all slots alike, by hash alone."""
    if counts:
        monkeypatch.setattr(near_dedup, "slot_counts", lambda texts: np.full(1 << near_dedup.ORDER_BITS, counts))
    rng = np.random.default_rng(4)
    body = []
    for i in range(60):
        words = [f"w{j}" for j in range(80)]
        for j in rng.integers(0, 80, i % 5):
            words[j] = f"x{rng.integers(3)}"
        body.append(" ".join(words[: 80 - i % 3]))
    body[7:9] = ["", body[3]]
    w = near_dedup.Weights(len(body), [])
    rows = [(bytes([i]), t) for i, t in enumerate(body)]
    marks = {}
    for r in near_dedup.prefixes(spark.createDataFrame(rows, "rid binary, text string"), lambda: w, 0.8).collect():
        marks.setdefault(r.rid[0], {})[r.h] = (r.rest, r.whole)
    a, b = (np.array(x) for x in zip(*itertools.combinations(range(len(body)), 2), strict=True))
    near = near_dedup.jaccard(pa.array([body[i] for i in a]), pa.array([body[i] for i in b]), w) >= 0.8
    assert 0 < near.sum() < len(near) and 7 not in marks
    for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
        both = marks[i].keys() & marks[j].keys()
        assert any(min(marks[i][h][0], marks[j][h][0]) >= (0.8 - 1e-6) / 1.8 * (marks[i][h][1] + marks[j][h][1]) for h in both)


def test_near_edges(odd, none):
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[5].class_id == by[6].class_id == 6 and by[0].class_id == by[1].class_id == 99 and by[2].class_id == 2
    assert near_dedup.one_of_each(odd).columns == odd.columns
    assert near_dedup.near_classes(none).count() == 0


def test_only_the_near_copy_of_an_id_goes(spark):
    """Null ids, and an id with two texts: the clean text stays where another of the same id is a near copy."""
    words = lambda k: " ".join(f"{k}w{i}" for i in range(200))
    near = words("a") + " end"
    rows = [(9, words("a")), (None, near), (None, words("b")), (None, words("c")), (None, None), (5, words("a") + " more"), (5, words("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text) for r in near_dedup.one_of_each(df).collect())
    assert left == Counter(r for r in rows if r not in ((None, near), (5, words("a") + " more")))


# --- packing ---


def test_best_fit_decreasing_against_scan():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
        rooms, rows = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = min((r for r in rooms if r >= lengths[i]), default=None)
            rooms.remove(fit) if fit is not None else None
            rooms.append((50 if fit is None else fit) - lengths[i])
        packed = packing.best_fit_decreasing(lengths, 50)
        assert sorted(i for row in packed for i in row) == list(range(len(lengths)))
        assert sorted(50 - sum(lengths[i] for i in row) for row in packed) == sorted(rooms)


def test_packed_rows_give_the_documents_back(spark, odd, none):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH, PATTERN).ranks, special_tokens={})
    found = defaultdict(list)
    for r in packing.packed(odd, PATH, PATTERN, row_tokens=128, window_tokens=3000).collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert positions[a:b].tolist() == list(range(b - a))
            found[r.doc_ids[k]].append((r.starts[k], r.parts[k], ids[a:b].tolist()))
    want = defaultdict(list)
    for r in odd.collect():
        want[r.doc_id] += [*enc.encode_ordinary(r.text or ""), 50256]
    for doc, parts in found.items():
        assert Counter(i for p in parts for i in p[2]) == Counter(want[doc])
    single = [5, 6, 7, 8]
    assert all([i for p in sorted(found[d]) for i in p[2]] == want[d] for d in single)
    assert packing.packed(none, PATH, PATTERN).count() == 0


# --- quality classifier ---


def test_quality_scores_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_quality_pu"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.95
    assert all(bool(r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.limit(50).collect())


def test_measures_against_plain_python():
    lines = ["The quick, brown fox!", "", "a a a a b b\nÜber 12 'x' & y.", "one two three four one two three four five", "  \n\t "]
    got = quality_pu.features(pa.array(lines))
    assert (got[[1, 4]] == 0).all()
    for t, row in zip(lines, got, strict=True):
        w = WORD.findall(t)
        if not w:
            continue
        raw = t.encode()
        kind = lambda pred: sum(map(pred, raw))  # noqa: E731, B023
        low, up, far = kind(lambda b: 97 <= b <= 122), kind(lambda b: 65 <= b <= 90), kind(lambda b: b >= 128)
        runs = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
        want = {
            "log_words": np.log1p(len(w)), "word_length": sum(len(x.encode()) for x in w) / len(w), "upper_share": up / max(1, low + up + far), "digit_share": kind(lambda b: 48 <= b <= 57) / len(raw),
            "beyond_share": far / max(1, low + up + far), "symbols_a_word": sum(t.count(c) for c in "#*$%&|<>") / len(w), "exclaims_a_word": t.count("!") / len(w),
            "stops_a_word": (t.count(".") + t.count("?")) / len(w), "commas_a_word": sum(t.count(c) for c in ",;:") / len(w), "quotes_a_word": (t.count("'") + t.count('"')) / len(w),
            "lines_a_word": t.count("\n") / len(w), "distinct_words": len(set(w)) / len(w), "distinct_runs": len(set(runs)) / max(1, len(w) - 3),
            "same_as_before": sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), "short_words": sum(len(x.encode()) <= 2 for x in w) / len(w), "long_words": sum(len(x.encode()) >= 12 for x in w) / len(w),
        }
        have = dict(zip(quality_pu.FEATURES, row.tolist(), strict=True))
        assert all(abs(have[k] - v) < 1e-5 for k, v in want.items())


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    n = len(quality_pu.FEATURES)
    for prior in (0.3, 0.6, 0.85):
        positive = rng.normal(1, 1, (3000, n))
        unlabelled = np.concatenate([rng.normal(1, 1, (int(6000 * prior), n)), rng.normal(-1, 1, (6000 - int(6000 * prior), n))])
        assert abs(quality_pu.estimated_prior(positive, unlabelled) - prior) < 0.05


def test_the_fitted_risk_is_least():
    """The non-negative risk, written out plainly, rises in every direction from where ``fit`` ends."""
    rng = np.random.default_rng(2)
    n = len(quality_pu.FEATURES)
    positive, unlabelled, prior = rng.normal(0.3, 1, (4000, n)), np.concatenate([rng.normal(0.3, 1, (3000, n)), rng.normal(-0.3, 1, (3000, n))]), 0.5
    s = quality_pu.fit(positive, unlabelled, prior, steps=3000)

    def risk(w, b):
        loss = lambda x, sign: np.logaddexp(0, -sign * (s.expand(x) @ w + b)).mean()
        return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1)) + quality_pu.DECAY / 2 * (w @ w + b * b)

    w = np.array(s.weights)
    least = risk(w, s.bias)
    for k in range(40):
        d = rng.normal(size=len(w))
        assert risk(w + 0.05 * d / np.linalg.norm(d), s.bias) > least - 1e-5 and risk(w, s.bias + 0.05 * (-1) ** k) > least - 1e-5


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, None), (None, 1), (6, 0)], "doc_id long, quality int")
    rows = quality_pu.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_pu.scored(none, labels.limit(0)).count() == 0


def test_negative_risk_is_held_at_zero():
    """Where positives are all of the text, the risk over negatives can't go below zero, so positives keep high scores."""
    x = np.random.default_rng(0).normal(size=(300, len(quality_pu.FEATURES)))
    s = quality_pu.fit(x, x, 0.9)
    logit = s.bias + s.expand(x) @ np.array(s.weights)
    assert (1 / (1 + np.exp(-logit))).mean() > 0.6


# --- BPE ---


def test_encoding_equals_the_library(spark, docs, odd, none):
    v = bpe.vocabulary(PATH, PATTERN)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for df in (docs, odd):
        text = df.select("doc_id", "text").collect()
        want = Counter()
        for r in text:
            ids = enc.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.encoding_digests(df, PATH, PATTERN).collect())) == want
    back = odd.select("text", bpe.decoded(bpe.encoded(F.col("text"), PATH, PATTERN), PATH, PATTERN).cast("string").alias("b"))
    assert all((r.text or "") == r.b for r in back.collect())
    assert bpe.encoding_digests(none, PATH, PATTERN).count() == 0


def test_every_prefix_has_the_encoding_of_the_merges():
    v = bpe.vocabulary(PATH, PATTERN)
    rng = random.Random(6)
    for _ in range(200):
        data = bytes(rng.choice(b"theingaerstion \xc3\xa9") for _ in range(rng.randint(1, 40)))
        last = v.extend(data, [])
        for end in range(1, len(data) + 1):
            assert v.walk(last[:end]) == v.merged(data[:end])
        assert v.short([data]) == [np.array(v.merged(data), "<u4").tobytes()]


def test_edits_and_appends_are_exact():
    v = bpe.vocabulary(PATH, PATTERN)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(7)
    for _ in range(300):
        e = bpe.Encoding(v, "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "1", "##", "'s", "\t"]) for _ in range(30)))
        for _ in range(4):
            a = rng.randint(0, len(e.text))
            e.edit(a, rng.randint(a, len(e.text)), rng.choice(["", "x", "the ", " ing", "\n\n"]))
            assert e.ids() == enc.encode_ordinary(e.text)
        e.append(" more")
        assert e.ids() == enc.encode_ordinary(e.text)
    e = bpe.Encoding(v, "word " * 500)
    e.edit(1000, 1004, "new")
    assert e.reused > 480


# --- sharding ---


def test_matrix_has_its_sums_and_distribution():
    m = sharding.communication_matrix([5, 0, 7, 4], [6, 5, 5], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 7, 4] and m.sum(axis=0).tolist() == [6, 5, 5]
    draws = np.array([sharding.communication_matrix([6, 6], [6, 6], s)[0, 0] for s in range(4000)])
    assert abs(draws.mean() - 3) < 0.06 and abs(draws.var() - 36 * 36 / (144 * 11)) < 0.06
    # Small enough to list every deal of four labelled rows, two from each partition, to two shards of two.
    ways = Counter(sum(r in (0, 1) for r in first) for first in itertools.combinations(range(4), 2))
    seen = Counter(int(sharding.communication_matrix([2, 2], [2, 2], s)[0, 0]) for s in range(6000))
    assert all(abs(seen[k] / 6000 - ways[k] / 6) < 0.02 for k in range(3))
    # As a tree the law is the same: three partitions, a group of two and one of one.
    tree = np.array([[sharding.Deal(np.array([2, 1, 3]), [3, 3], s, 2).row(p) for p in range(3)] for s in range(3000)])
    assert (tree.sum(axis=1) == 3).all() and (tree.sum(axis=2) == [2, 1, 3]).all()
    deals = Counter(tuple(sum(r in part for r in first) for part in ((0, 1), (2,), (3, 4, 5))) for first in itertools.combinations(range(6), 3))
    drawn = Counter(map(tuple, tree[:, :, 0].tolist()))
    assert set(drawn) == set(deals) and all(abs(drawn[k] / 3000 - deals[k] / 20) < 0.03 for k in deals)
    big = np.array([sharding.hypergeometric(np.random.default_rng(s), 2 * 10**9, 2 * 10**9, 10_000) for s in range(300)])
    assert abs(big.mean() - 5000) < 12 and abs(big.std() - 50) < 8


def test_shards_are_even_gapless_and_uniform(spark, odd, none):
    df = spark.range(0, 5000, 1, 7).withColumn("slot", F.lit("clash"))
    rows = sharding.shuffle_into_shards(df, 6, bucket_rows=100).collect()
    assert sorted(r.id for r in rows) == list(range(5000))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {833, 834}
    first = Counter(r.shard for r in rows if r.id < 700)  # one input partition over the shards
    assert all(80 < n < 155 for n in first.values())
    at = np.array([[r.id, r.slot] for r in rows if r.shard == 0])
    assert abs(np.corrcoef(at.T)[0, 1]) < 0.12
    got = sharding.shard_digests(odd, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sharding.shuffle_into_shards(odd, 4).columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert sharding.shard_digests(none).count() == 0


def test_whole_documents_are_shuffled(monkeypatch, odd):
    shuffle, given = sharding.shuffle_into_shards, []
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a, **k: given.append(df.columns) or shuffle(df, *a, **k))
    assert sharding.shard_digests(odd, 4).count() == odd.count()
    assert given == [odd.columns]


# --- language ---


def brute_phrases(text, train):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(9)
    train = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(2)]
    pieces = [np.array([0 if c == " " else ord(c) - 96 for c in t], np.uint8) for t in train]
    automata = tuple((a.tobytes(), c.tobytes(), t.tobytes(), n) for a, c, t, n in map(langid.suffix_automaton, pieces))
    parser = langid.Parser(langid.Model(("x", "y"), (300, 300), automata))
    probes = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (0, 1, 5, 40, 200, 7)]
    s = [np.array([0 if c == " " else ord(c) - 96 for c in t], np.uint8) for t in probes]
    got = parser.phrases(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])]))
    parted = langid.Parser(parser.model, group_entries=1)  # a language at a time
    assert len(parted.groups) == 2 and (parted.phrases(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])])) == got).all()
    for k, t in enumerate(train):
        assert got[k].tolist() == [brute_phrases(p, t) for p in probes]


def test_language_of_held_out_documents(spark, docs):
    rows = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97
    assert all(bool(r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in langid.predicted(docs).limit(40).collect())


def test_a_label_with_one_short_text_takes_nothing(spark, docs):
    stray = [i for i in range(10**6, 10**6 + 50) if zlib.crc32(str(i).encode()) % 3 != 1][:1]  # learnt from
    rng = random.Random(4)
    junk = [(2 * 10**6 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), "zz") for i in range(20)]
    texts_ = docs.select("doc_id", "text", "lang")
    more = texts_.union(spark.createDataFrame([(i, "ok", "xx") for i in stray], texts_.schema))
    with_stray = {r.doc_id: r.lang_pred for r in langid.predicted(more).collect() if r.doc_id < 10**6}
    assert with_stray == {r.doc_id: r.lang_pred for r in langid.predicted(texts_).collect()} and "xx" not in with_stray.values()
    model = langid.train(more)
    bits = lambda m: [r.bits for r in langid.identify(spark.createDataFrame(junk, texts_.schema), m, [F.col("doc_id")]).orderBy("doc_id").collect()]
    assert bits(model) == bits(langid.train(texts_))


def test_language_edges(spark, docs, odd, none):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(odd, model, [F.col("doc_id")]).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[8].lang_pred == "und" and got[0].score == 0
    assert langid.predicted(none).count() == 0
    lone = langid.predicted(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in lone.collect()} == {"und"}
    assert langid.accepted(docs).columns == docs.columns and langid.accepted(docs).count() == docs.count()
    assert langid.accepted(none).count() == 0


# --- quality rules ---


def test_rules_on_odd_texts(odd, none):
    got = quality_rules.judged(odd).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 20)
    assert quality_rules.judged(none).count() == 0
    for r in got:
        if r.doc_id == 9:
            assert (r.n_words, r.n_dup_lines, r.n_lines) == (3, 1, 3)


def test_rules_filter_and_join_in_about_the_same_time(spark, docs):
    def seconds(make):
        make().collect()
        start = time.monotonic()
        rows = make().collect()
        return time.monotonic() - start, rows

    plain, rows = seconds(lambda: quality_rules.judged(docs))
    kept, good = seconds(lambda: quality_rules.judged(docs).filter("kept"))
    joined, _ = seconds(lambda: quality_rules.judged(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("kept and n_words > 30"))
    assert good and sorted(r.doc_id for r in good) == sorted(r.doc_id for r in rows if r.kept)
    assert kept < 2 * plain + 1 and joined < 2 * plain + 2


def test_rules_keep_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x = quality_rules.judged(docs).toPandas().merge(labels.toPandas(), on="doc_id")
    x = x[~x.base_failed]
    assert x[x.quality == 1].kept.mean() > 0.97


def test_word_count_matches_pattern(odd):
    rows = odd.select("text", texts.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in rows)

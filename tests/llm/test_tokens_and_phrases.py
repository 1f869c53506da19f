"""Pieces against their library, phrases against plain counting, alignments against plain grouping with both libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lumentrack.llm import alignment, bpe, phrases, pieces

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
BITS = [*"ab  ▁\n\t\x00éßa'1<>s/.,", "中", "国", "的", "😀", "́", " ", "ﬁ", "Ж", "и", "the", " the", "    ", "\x85", "ing", "�", "\U0010ffff", "<s>", "</s>", "<|endoftext|>", " don't", "  \n", "naïve "]
FIXED = [None, "", " ", "  ", "▁", "a▁b", "\n", "The cat sat.", "x" * 300, "ab" * 9000, " " * 70, "中" * 200, "wörter " * 4000, "a\n\n b", "</s>", "é" * 60 + "▁" + "é" * 60]


def texts(n, seed=1):
    draw = random.Random(seed)
    return FIXED + ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def table(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_pieces_equal_the_library(library):
    v, rows = pieces.loaded(MODEL), [t or "" for t in texts(3000)]
    mine = v.encode_all(rows)
    want = library.encode(rows, num_threads=2)
    assert [np.frombuffer(m, "<u4").tolist() for m in mine] == want
    assert [v.decode(m) for m in mine] == library.decode(want, num_threads=2)


def test_any_ids_decode_as_the_library_does(library):
    draw = random.Random(2)
    lists = [[draw.choice([draw.randint(0, 300), draw.randint(0, 31999)]) for _ in range(draw.randint(1, 12))] for _ in range(2000)]
    v = pieces.loaded(MODEL)
    assert [v.decode(np.array(x, "<u4").tobytes()) for x in lists] == library.decode(lists, num_threads=2)


def test_each_prefix_has_its_own_last_token():
    v, draw = pieces.loaded(MODEL), random.Random(3)
    for _ in range(300):
        s = "".join(draw.choice("▁▁▁etainosrh") for _ in range(draw.randint(1, 40)))
        last = v.last_tokens(s)
        assert [v.token[t] for t in last] == [v.merged(s[: i + 1])[-1] for i in range(len(s))]


def test_parts_of_a_text_are_encoded_alone_at_spaces(library):
    v = pieces.loaded(MODEL)
    assert v.encode("one two", True) + v.encode(" three", False) == v.encode("one two three")


def test_piece_digests(spark, library):
    rows = texts(100)
    docs = table(spark, [(i, t, "x") for i, t in enumerate(rows)] + [(3, "again", "x")] * 2).withColumnsRenamed({"lang": "n_tokens"})
    got = sorted(map(tuple, pieces.encoding_digests(docs, MODEL).collect()))
    want = []
    for i, t in [*enumerate(rows), (3, "again"), (3, "again")]:
        ids = [*library.encode(t or "", num_threads=1), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    assert pieces.encoding_digests(docs.filter("false"), MODEL).count() == 0


def test_pieces_as_columns(spark, library):
    docs = table(spark, [(1, "a  b\n", "x"), (2, None, "x")])
    got = {r["doc_id"]: r for r in docs.select("doc_id", pieces.encoded(docs.text, MODEL).alias("ids")).withColumn("back", pieces.decoded("ids", MODEL)).collect()}
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == library.encode("a  b\n") and got[1]["back"] == "a  b\n" and got[2]["back"] == ""


def plain_phrases(rows, floor, most):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= floor}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["the", "of", "New", "york", "città", "é", "a", "AB", "x y", "z"]
    rows = []
    for i in range(n):
        s = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(draw.randint(0, 40)))
        rows.append((i, s + draw.choice(["", " one two three four five six", "one two\tTHREE four five six.", "New York city"]), draw.choice(["en", "fr", None, "und"])))
    return [*rows, (0, None, "en"), (1, "", None), (2, " \n\t.", "de"), rows[0], rows[0]]


@pytest.mark.parametrize(("floor", "most"), [(10, 2000), (3, 7)])
def test_phrases_equal_plain_counting(spark, floor, most):
    rows = corpus(floor, 150)
    docs = table(spark, rows).withColumn("phrase", F.lit("clash"))
    got = sorted(map(tuple, phrases.collocations(docs, floor=floor, most=most).collect()))
    assert got and got == plain_phrases(rows, floor, most)
    assert phrases.collocations(docs.filter("false")).count() == 0


def test_full_slots_change_nothing(spark, monkeypatch):
    """With one slot bit in each part nearly all groups are counted by their words."""
    monkeypatch.setattr(phrases, "TABLE_BITS", 12)
    rows = corpus(5, 60)
    assert sorted(map(tuple, phrases.collocations(table(spark, rows), floor=3).collect())) == plain_phrases(rows, 3, 2000)


def test_long_texts_are_cut_at_ends_of_pieces(spark, monkeypatch):
    rows = [(0, " ".join(t or "" for _, t, _ in corpus(6, 300)), "en"), (1, "one two three " * 3000, "en")]
    monkeypatch.setattr(phrases, "BLOCK", 1 << 9)
    data = {}
    for block in (1 << 9, 1 << 22):
        monkeypatch.setattr(phrases, "BLOCK", block)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows]), pa.array(["en", None])], names=["text", "lang"])
        found = Counter()
        for words, langs in phrases._blocks(batch):
            for i in range(len(words.start)):
                found[langs[words.text[i]], words.spelled(i, int(words.room[i]))] += 1
        data[block] = found
    assert data[1 << 9] == data[1 << 22]


def test_paths_join_what_only_occurs_together(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta. eta theta iota", "en") for i in range(12)] + [(99, "theta iota kappa", "en")] * 12
    counts = spark.createDataFrame([("en", " ".join(p), len(p), n) for p, n in plain_counts(rows).items()], "lang string, phrase string, words int, f long")
    found = {(r["phrase"], r["words"], r["f"]) for r in phrases.path_phrases(phrases.unary_paths(counts)).collect()}
    assert found == {("alpha beta gamma delta epsilon zeta", 6, 12), ("eta theta iota", 3, 12), ("theta iota kappa", 3, 12)}


def plain_counts(rows):
    out = Counter()
    for _, text, _ in rows:
        for piece in text.split("."):
            w = piece.split()
            for k in (1, 2, 3):
                out.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return out


def byte_level():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}


@pytest.fixture(scope="module")
def both(library):
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    back = byte_level()

    def run(text):
        if not text:
            return [], [], [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = library.encode(text, num_threads=1)
        bytes_b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [library.id_to_piece(i)]]
        want = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else ([], [], [], [])

    return run


def plain_alignments(rows, both):
    made, counts = [], Counter()
    for doc, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = both(text)
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for c in common:
            groups.append((tuple(i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= c), tuple(i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= c)))
            low = c
        links = [(a, b) for a, x in zip(ids_a, ends_a, strict=True) for b, y in zip(ids_b, ends_b, strict=True) if x == y] if len(ids_a) < 2000 else [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        made.append((doc, len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, n_a, n_b, groups, links in made:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(said) if groups else ""))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"long_chars": 40, "range_bytes": 32}, {"long_chars": 25, "range_bytes": 7}])
def test_alignments_equal_plain_grouping(spark, both, options):
    short = [t if t is None or len(t) < 3000 else t[:1500] for t in texts(120, 4)]
    rows = [*enumerate(short), (900, "y" * 5000 + " end"), (901, " " * 3000 + "z"), (5, "again and again"), (5, "again and again")]
    docs = table(spark, [(i, t, "x") for i, t in rows]).withColumnsRenamed({"lang": "links"})
    got = alignment.alignment_digests(docs, RANKS, P.PATTERN, MODEL, **options).collect()
    assert sorted(map(tuple, got)) == plain_alignments(rows, both)


def test_alignment_of_an_empty_table(spark):
    docs = table(spark, [(1, "a", "x")]).filter("false")
    assert alignment.alignment_digests(docs, RANKS, P.PATTERN, MODEL).count() == 0


def test_fragments_compose_associatively():
    pair, draw = alignment.pair_of(RANKS, P.PATTERN, MODEL), random.Random(7)
    text = "Unbelievably naïve 中国 internationalisation of the tokenizers' étude   of 12345 things"
    a, b = np.frombuffer(pair.a.encode(" " + text), "<u4"), np.frombuffer(pair.b.encode(text), "<u4")
    ends_a, ends_b = np.cumsum(pair.a.length[a]), np.cumsum(pair.b.length[b])
    whole = alignment.Groups(a, ends_a, b, ends_b).fragment(pair.size).whole()
    for _ in range(50):
        cuts = [0, *sorted(draw.sample(range(1, int(ends_a[-1])), draw.randint(1, 12))), int(ends_a[-1])]
        parts = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            of_a, of_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
            parts.append(alignment.Groups(a[of_a], ends_a[of_a], b[of_b], ends_b[of_b]).fragment(pair.size))
        while len(parts) > 1:
            i = draw.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].then(parts[i + 1])]
        said, links = parts[0].whole()
        assert said == whole[0] and links.tolist() == whole[1].tolist()


def test_bound_of_the_table_of_counts():
    pair = alignment.pair_of(RANKS, P.PATTERN, MODEL)
    seen = set()
    for t in texts(500, 9):
        if t and "▁" not in t:
            a, b = np.frombuffer(pair.a.encode(" " + t), "<u4"), np.frombuffer(pair.b.encode(t), "<u4")
            seen |= set(alignment.Groups(a, np.cumsum(pair.a.length[a]), b, np.cumsum(pair.b.length[b])).links.tolist())
    assert len(seen) < pair.most_links() < 1_000_000
    assert all(pair.a.tokens[x >> 16].endswith(pair.b.data[x & 0xFFFF]) or pair.b.data[x & 0xFFFF].endswith(pair.a.tokens[x >> 16]) for x in seen)
    assert bpe.vocabulary(RANKS, P.PATTERN) is pair.a

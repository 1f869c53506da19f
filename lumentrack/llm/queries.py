"""Registered queries of this subpackage, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrack.llm import alignment, bpe, exact_dedup, langid, mixing, near_dedup, packing, phrases, pieces, quality_pu, quality_rules, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row_key")


#: Three captures of each page: a full response, a revisit, and a later revisit by another spelling of the URL. Every
#: fifth page has changed its entity tag, every seventh sends dates instead of tags, every eleventh sends neither.
_CAPTURES = """
    SELECT concat(page_id, '-', k) AS record_id,
           CASE WHEN k = 2 THEN concat(url, '#top') ELSE url END AS url,
           page_id * 37 % 100003 * 60 + k * 50000 AS ts,
           CASE WHEN k = 0 THEN 'response' ELSE 'revisit' END AS kind,
           CASE WHEN k = 0 THEN 200 ELSE 304 END AS status,
           CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN NULL WHEN k = 2 THEN concat('W/"', md5(html), '"')
                WHEN k = 1 AND page_id % 5 = 0 THEN '"changed"' ELSE concat('"', md5(html), '"') END AS etag,
           CASE WHEN page_id % 7 = 0 THEN concat('day ', page_id % 3) END AS last_modified,
           CASE WHEN k = 0 THEN 'text/html' ELSE 'text/plain' END AS content_type,
           concat('age ', k) AS cache_control,
           CASE WHEN k = 0 THEN concat('server ', page_id % 4) END AS server,
           CASE WHEN k = 0 THEN md5(html) END AS payload_digest
    FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS captures"""


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    records = spark.sql(_CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    headers = F.create_map(F.lit("Content-Type"), "content_type", F.lit("Cache-Control"), "cache_control", F.lit("Server"), "server")
    records = records.withColumn("headers", F.map_filter(headers, lambda k, v: v.isNotNull()))
    found = warc.resolve_revisits(records)
    return found.withColumn("headers", warc.header_text(F.col("headers")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.packing_digests(rows)


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(_table(spark, sf_dir, "documents"), stable=True)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.alignment_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_quality_pu": op6_quality_pu,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_langid": op9_langid,
    "op10_quality_rules": op10_quality_rules,
    "op11_pieces": op11_pieces,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
}


def _verdict_sql() -> str:
    parts = []
    for rule in quality_rules.RULES:
        value = rule.measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")
        if rule.low is not None:
            parts.append(f"coalesce({value} >= {rule.low}, true)")
        if rule.high is not None:
            parts.append(f"coalesce({value} <= {rule.high}, true)")
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.CASED)
_HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"

ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op3_warc_revisits": rf"""
        WITH pages AS (SELECT page_id, url, coalesce(html, '') AS html FROM main.pages),
        captures AS ({_CAPTURES}),
        parts AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM captures),
        cut AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^(?:[^/?]*@)?([^/?]*)', 1)), ':(80|443)$', '') AS host,
                regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                regexp_extract(bare, '\?(.*)$', 1) AS query FROM parts),
        queries AS (SELECT record_id, string_agg(p, '&' ORDER BY p) AS q FROM (
            SELECT record_id, unnest(string_split(query, '&')) AS p FROM cut) WHERE p <> '' AND NOT regexp_matches(p, '^{warc.TRACKING}(=|$)') GROUP BY record_id),
        r AS (SELECT cut.*, host || path || coalesce('?' || q, '') AS u FROM cut LEFT JOIN queries USING (record_id)),
        pairs AS (
            SELECT v.record_id, v.u AS canonical_url, v.etag AS v_etag, v.last_modified AS v_date, v.cache_control AS v_cache, f.*  EXCLUDE (record_id, u),
                   f.record_id AS response_id, row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
            FROM r AS v LEFT JOIN r AS f ON f.u = v.u AND f.kind = 'response' AND f.ts < v.ts WHERE v.kind = 'revisit'),
        judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                WHEN v_etag IS NOT NULL AND etag IS NOT NULL THEN CASE WHEN replace(v_etag, 'W/', '') = etag THEN 'resolved' ELSE 'validator_mismatch' END
                WHEN v_date IS NOT NULL AND last_modified IS NOT NULL THEN CASE WHEN v_date = last_modified THEN 'resolved' ELSE 'validator_mismatch' END
                ELSE 'no_validator' END AS verdict FROM pairs WHERE n = 1)
        SELECT record_id, canonical_url, response_id, verdict, CASE WHEN verdict = 'resolved' THEN payload_digest END AS payload_digest,
               CASE WHEN verdict = 'resolved' THEN 'cache-control: ' || v_cache || chr(10) || 'content-type: ' || content_type || chr(10) || 'server: ' || server END AS headers
        FROM judged""",
    "op10_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        words AS (
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, word FROM (
                SELECT doc_id, unnest(string_split_regex(t, '[\x20\x09-\x0D]+')) AS word,
                       generate_subscripts(string_split_regex(t, '[\x20\x09-\x0D]+'), 1) AS k FROM d) WHERE word <> ''),
        windows AS (
            SELECT doc_id, i, word, count(*) OVER w AS n_in, string_agg(word, ' ') OVER w AS win FROM words
            WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
        twins AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE n_in = 8) WHERE n > 1),
        repeated AS (SELECT doc_id, sum(least(8, gap)) AS n_repeat_words FROM (
            SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS gap FROM twins) GROUP BY doc_id),
        word_counts AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
            count(*) FILTER (word IN ({_STOPS})) AS n_stop_words FROM words GROUP BY doc_id),
        line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
            count(*) FILTER (rtrim(line, ' ') LIKE '%...' OR rtrim(line, ' ') LIKE '%…') AS n_ellipsis_lines,
            count(*) FILTER (left(ltrim(line, ' '), 1) IN ('-', '*', '•')) AS n_bullet_lines
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE {_HAS_WORD} GROUP BY doc_id),
        m AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words,
                   length(t) - length(replace(t, '!', '')) AS n_exclaims,
                   coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines
            FROM d LEFT JOIN word_counts USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND {_verdict_sql()} AS kept,
               n_lines::BIGINT AS n_lines, n_stop_words::BIGINT AS n_stop_words, n_exclaims::BIGINT AS n_exclaims,
               n_ellipsis_lines::BIGINT AS n_ellipsis_lines, n_bullet_lines::BIGINT AS n_bullet_lines
        FROM b""",
    "op12_phrases": r"""
        WITH pieces AS (SELECT lang, row_number() OVER () AS pid, string_split_regex(p, '[\x20\x09]+') AS s FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        words AS (SELECT lang, pid, k, word FROM (
            SELECT lang, pid, unnest(s) AS word, generate_subscripts(s, 1) AS k FROM pieces) WHERE word <> ''),
        runs AS (SELECT lang, word AS w1, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM words WINDOW w AS (PARTITION BY pid ORDER BY k)),
        f AS (SELECT lang, w1 AS phrase, 1 AS size, count(*) AS f FROM runs GROUP BY ALL
            UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL),
        totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
        candidates AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3 FROM f WHERE size > 1 AND f >= 10),
        holders AS (SELECT lang, phrase, max(f) AS f_longer FROM (
            SELECT lang, w1 || ' ' || w2 AS phrase, f FROM candidates WHERE size = 3
            UNION ALL SELECT lang, w2 || ' ' || w3, f FROM candidates WHERE size = 3) GROUP BY ALL),
        kept AS (SELECT candidates.* FROM candidates LEFT JOIN holders USING (lang, phrase) WHERE size = 3 OR coalesce(100 * f_longer < 50 * f, true)),
        cuts AS (SELECT lang, phrase, f AS a, 1 AS k, w1 AS head, CASE WHEN size = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM kept
            UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM kept WHERE size = 3),
        scores AS (SELECT cuts.*, h.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * r.f) AS score FROM cuts
            JOIN f AS h ON h.lang = cuts.lang AND h.phrase = head JOIN f AS r ON r.lang = cuts.lang AND r.phrase = rest),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
}

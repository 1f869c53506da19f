"""Resolution of not-modified revisit records of web archives.

A revisit stands for the latest earlier full response of its canonical URL, if its validators agree with that
response's; its headers then update the stored ones, as a cache would (RFC 9111, 3.2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified response mustn't change: those of the connection and of the stored body.
NOT_MERGED = (
    "connection content-encoding content-length content-md5 content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()
BUCKET_SECONDS = 86_400
#: Query parameters that only track the visit.
TRACKING = "(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port or user part, path without a lone final slash, query sorted without tracking, no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[^/?]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    joined = F.array_join(F.sort_array(kept), "&")
    return F.concat(host, path, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))


def _etag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _lower_keys(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the fields of ``fresh`` that may replace it. Names compare without case and come out in lower case."""
    old, new = _lower_keys(stored), F.map_filter(_lower_keys(fresh), lambda k, v: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve_revisits(records: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, response_id, verdict, payload_digest, headers.

    ``records`` has record_id, url, ts (seconds, long), kind ('response' or 'revisit'), status, etag,
    last_modified, headers (map) and payload_digest; a full response has status 200 and a digest. Earlier means a
    smaller ts; of responses at one time the largest record_id counts. Verdicts: 'resolved'; 'validator_mismatch'
    (etags, compared weakly, or without them the last-modified dates differ); 'no_validator' (nothing to compare);
    'no_response' (none earlier, or url or ts null). Only resolved rows have payload_digest and merged headers.
    Other columns aren't read. Bodies don't move: a digest stands for them.

    A URL's records are parted by time: each part is searched by itself and gets what was last stored before it, so
    that no task holds all records of a hot URL.
    """
    rows = records.select(
        "record_id", "kind", "etag", "last_modified", "headers", "payload_digest", canonical_url(F.col("url")).alias("u"), F.col("ts").cast("long").alias("ts"),
        ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload_digest").isNotNull()).alias("full"),
    ).filter((F.col("kind") == "revisit") | F.col("full"))
    rows = rows.withColumn("b", F.floor(F.col("ts") / bucket_seconds))
    stored = F.when(F.coalesce("full", F.lit(False)), F.struct("record_id", "etag", "last_modified", "headers", "payload_digest"))
    newest = F.struct("ts", "record_id")
    rows = rows.withColumn("stored", stored)
    before = Window.partitionBy("u", "b").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max_by("stored", F.when(F.col("stored").isNotNull(), newest)).over(before)
    revisits = rows.withColumn("near", near).filter("kind = 'revisit'").drop("stored")
    ends = rows.filter("full and ts is not null").groupBy(F.col("u").alias("u2"), F.col("b").alias("b2")).agg(F.max_by("stored", newest).alias("end"))
    # A part's predecessor is the part of the URL that last ended with a response.
    parts = rows.select(F.col("u").alias("u2"), F.col("b").alias("b2")).distinct()
    earlier = Window.partitionBy("u2").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(ends, ["u2", "b2"], "left").withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("u2", "b2", "carried")
    found = revisits.join(carried, (F.col("u") == F.col("u2")) & (F.col("b") == F.col("b2")), "left")
    found = found.withColumn("r", F.when(F.col("ts").isNotNull() & F.col("u").isNotNull(), F.coalesce("near", "carried")))
    both_tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    agree = F.when(both_tags, _etag(F.col("etag")) == _etag(F.col("r.etag"))).when(both_dates, F.col("last_modified") == F.col("r.last_modified"))
    verdict = F.when(F.col("r").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    ok = F.col("verdict") == "resolved"
    return found.withColumn("verdict", verdict).select(
        "record_id", F.col("u").alias("canonical_url"), F.col("r.record_id").alias("response_id"), "verdict",
        F.when(ok, F.col("r.payload_digest")).alias("payload_digest"), F.when(ok, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """A map of headers as sorted lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.sort_array(lines), "\n")

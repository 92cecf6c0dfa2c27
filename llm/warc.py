"""WARC captures: not-modified revisits resolved to the response they confirm.

A revisit holds the head of a 304 answer and no body. It is resolved by an as-of join on the
canonical URL: the latest earlier full response, if their validators agree. The result has
the response's payload and its headers, updated by those a 304 may change.

One URL may hold a large share of all captures, so the join runs in two levels: captures are
cut into time slices of equal row counts; within (URL, slice) a window finds the latest
response, and what precedes the slice comes from one row per (URL, slice), carried forward.
Payloads do not travel through the windows; they are joined by record at the end.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.common import materialise

SLICE_ROWS = 20_000
MOST_SLICES = 1_000
# Headers of a stored response that a 304 answer never changes.
KEPT_HEADERS = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
                "transfer-encoding", "connection", "trailer", "upgrade", "keep-alive", "te"]
NOT_MODIFIED = "server-not-modified"
TRACKING = r"(^|&)utm_[^&=]*(=[^&]*)?"


def canonical_url(url: Column) -> Column:
    """Key under which captures of one resource meet: scheme, fragment, ``www.``, default
    ports, tracking parameters and a last slash do not count; the host is in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), TRACKING, ""), r"^&", "")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def header_lines(block: Column) -> Column:
    return F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[!-9;-~]+:"))


def headers_of(lines: Column) -> Column:
    """``map<name, value>`` of lines ``Name: value``; names in lower case, the last of a
    repeated name counts."""
    names = F.transform(lines, lambda x: F.lower(F.substring_index(x, ":", 1)))
    values = F.transform(lines, lambda x: F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))))
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values)).otherwise(
        F.map_from_entries(last))


def parse_records(blocks: DataFrame) -> DataFrame:
    """Records from ``(record_id, warc_head, http_head, payload)``: adds ``url, captured_at``
    (epoch seconds), ``kind`` (``response`` for a full answer, ``revisit`` for a 304) and
    ``headers``; other record types have a null kind."""
    status = F.regexp_extract(F.coalesce("http_head", F.lit("")), r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    lines = blocks.select("record_id", header_lines(F.col("warc_head")).alias("warc"), status.alias("status"),
                          header_lines(F.col("http_head")).alias("http"), "payload")
    parsed = lines.select("record_id", headers_of(F.col("warc")).alias("w"), "status", headers_of(F.col("http")).alias("headers"),
                          "payload")
    unmodified = (F.col("status") == "304") | (F.col("status") == "") & F.coalesce(F.col("w")["warc-profile"], F.lit("")).contains(NOT_MODIFIED)
    kind = F.when((F.col("w")["warc-type"] == "revisit") & unmodified, "revisit").when(
        (F.col("w")["warc-type"] == "response") & (F.col("status") == "200"), "response")
    return parsed.select("record_id", F.col("w")["warc-target-uri"].alias("url"),
                         F.try_to_timestamp(F.col("w")["warc-date"], F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]'Z'")).cast("double").alias("captured_at"),
                         kind.alias("kind"), "headers", "payload")


def _sliced(rows: DataFrame, slice_rows: int, most: int) -> DataFrame:
    n = min(most, max(1, -(-rows.count() // slice_rows)))
    cuts = sorted(set(rows.approxQuantile("captured_at", [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    if not cuts:
        return rows.withColumn("_slice", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_slice", handleInvalid="keep")
    return cut.transform(rows.withColumn("_at", F.col("captured_at").cast("double"))).drop("_at")


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS, most_slices: int = MOST_SLICES) -> DataFrame:
    """``(record_id, url_key, outcome, response_id, headers, payload)``, one row per revisit of
    ``records (record_id, url, captured_at, kind, headers, payload)``.

    The response is the latest of the same canonical URL captured strictly earlier; of equal
    times the larger record_id. ``outcome`` is ``resolved``; ``no_response`` if there is none,
    or URL or time are null; ``mismatch`` if entity tags, or without them modification dates,
    differ; ``unchecked`` if no validator is given on both sides. Only resolved rows have
    headers of the response and a payload; others keep their own headers. Repeated records are
    resolved one by one. Records of other kinds and other columns are ignored; an empty table
    gives no rows.
    """
    heads = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.round(F.col("captured_at").cast("double") * 1_000_000).try_cast("bigint").alias("captured_at"),
        "kind", "headers")
    heads = materialise(heads, "captures")
    sliced = _sliced(heads.where("url_key is not null and captured_at is not null"), slice_rows, most_slices)
    # Maps cannot be ordered, so a response is compared by time and id and carries its headers as entries.
    full = F.when(F.col("kind") == "response", F.struct(
        "captured_at", "record_id", F.map_entries("headers").alias("headers")))
    marked = sliced.withColumn("full", full)
    before = marked.groupBy("url_key", "_slice").agg(F.max("full").alias("full")).select(
        "url_key", "_slice", F.max("full").over(
            Window.partitionBy("url_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("url_key", "_slice").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    latest = marked.withColumn("inner", F.max("full").over(inside)).where("kind = 'revisit'").join(
        before, ["url_key", "_slice"]).select("record_id", "url_key", "headers", F.coalesce("inner", "carried").alias("found"))
    lost = heads.where("kind = 'revisit' and (url_key is null or captured_at is null)").select(
        "record_id", "url_key", "headers", F.lit(None).cast(latest.schema["found"].dataType).alias("found"))
    matched = latest.unionByName(lost).withColumn("stored", F.map_from_entries("found.headers"))
    tag = lambda h: F.regexp_replace(F.col(h)["etag"], r"^W/", "")
    date = lambda h: F.col(h)["last-modified"]
    same = F.coalesce(tag("headers") == tag("stored"), date("headers") == date("stored"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "unchecked").when(
        same, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    judged = materialise(matched.withColumn("outcome", outcome).select(
        "record_id", "url_key", "outcome",
        F.when(F.col("outcome").isin("resolved", "mismatch", "unchecked"), F.col("found.record_id")).alias("response_id"),
        F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers")), "judged")
    # Ids are those of responses already; of a repeated id the first payload that is not null counts.
    bodies = records.where("payload is not null").groupBy(F.col("record_id").alias("response_id")).agg(
        F.first("payload").alias("payload"))
    resolved = judged.where("outcome = 'resolved'").join(bodies, "response_id", "left").select(*judged.columns, "payload")
    return resolved.unionByName(judged.where("outcome <> 'resolved'").withColumn("payload", F.lit(None).cast("string")))


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl history of ``pages``, by rule: each page is captured in full; every third page
    changes later; revisits confirm the first capture, come before it, or ask for a version
    that is gone."""
    pages = pages.select("page_id", "url", "html", F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
                         F.length("html").alias("size"))
    tag = F.col("digest")
    page, second = F.col("page_id"), F.lit(1_000_000)
    rows = F.array(
        F.struct(F.lit(0).alias("turn"), page.alias("at"), F.lit("response").alias("type"), F.concat(F.lit("a"), tag).alias("tag")),
        F.struct(F.lit(1).alias("turn"), (page + second).alias("at"), F.lit("revisit").alias("type"), F.concat(F.lit("a"), tag).alias("tag")),
        F.struct(F.lit(2).alias("turn"), (page + second * 2).alias("at"),
                 F.when(page % 3 == 0, "response").otherwise("revisit").alias("type"),
                 F.when(page % 3 == 0, F.concat(F.lit("b"), tag)).when(page % 7 == 0, F.lit("gone")).otherwise(
                     F.concat(F.lit("a"), tag)).alias("tag")),
        F.struct(F.lit(3).alias("turn"), (page - second).alias("at"), F.lit("revisit").alias("type"), F.concat(F.lit("a"), tag).alias("tag")),
        F.struct(F.lit(4).alias("turn"), (page + second * 3).alias("at"), F.lit("revisit").alias("type"), F.concat(F.lit("a"), tag).alias("tag")))
    each = pages.select("page_id", "url", "html", "size", F.explode(rows).alias("r")).select(
        "page_id", "url", "html", "size", "r.*")
    full = F.col("type") == "response"
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return each.select(
        (F.col("page_id") * 5 + F.col("turn")).alias("record_id"),
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("type"), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
                 F.lit("\r\nWARC-Date: "), stamp, F.lit("\r\n")).alias("warc_head"),
        F.concat(F.when(full, "HTTP/1.1 200 OK").otherwise("HTTP/1.1 304 Not Modified"), F.lit('\r\nETag: "'), F.col("tag"),
                 F.lit('"\r\nX-Turn: '), F.col("turn").cast("string"), F.lit("\r\nContent-Length: "),
                 F.when(full, F.col("size")).otherwise(0).cast("string"), F.lit("\r\n")).alias("http_head"),
        F.when(full, F.col("html")).alias("payload"))

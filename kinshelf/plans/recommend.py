"""Recommendation jobs over a batch of requests, for both profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinshelf.functions.display import ESSENTIAL, RECORD, display, reason, shown_score
from kinshelf.functions.titles import author_key, sanitise, title_key
from kinshelf.functions.validation import limit_error, limit_value, validate_requests
from kinshelf.operators.lookup import resolve
from kinshelf.operators.ranking import greedy, works_of, zero_fill
from kinshelf.operators.scoring import scores, top
from kinshelf.params import DEFAULT_LIMIT, MAX_LIMIT_SIMPLE, MIN_LIMIT
from kinshelf.plans.model import Model
from kinshelf.session import materialise, small


def book_keys(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "id", title_key(F.col("title")).alias("title_key"), author_key(F.col("authors")).alias("author_key"))


def find_titles(requests: DataFrame, model: Model) -> DataFrame:
    """Title resolution alone, stages one and two: ``(request_id, found, message, source_id)``
    and the record of the book, nulls if there is none."""
    keyed = materialise(requests.select(
        "request_id", title_key(sanitise(F.col("title"))).alias("key"), F.lit("").alias("scan_key")), "keyed")
    found = resolve(keyed, model.titles, None, model.title_index)
    met = F.col("source_id").isNotNull()
    # Fixed value: the message.
    message = F.when(~met, F.concat(F.lit("No book found matching '"), F.col("title"), F.lit("'")))
    heads = requests.select("request_id", "title").join(found, "request_id", "left").select(
        "request_id", met.alias("found"), message.alias("message"), "source_id")
    record = display(model.catalogue).withColumnRenamed("id", "source_id")
    return heads.join(record, "source_id", "left").select(*heads.columns, *[c for c in RECORD if c != "id"])


def check_requests(requests: DataFrame) -> DataFrame:
    return validate_requests(requests)


def check_requests_simple(requests: DataFrame) -> DataFrame:
    """The simple profile takes any title and limits of 1 to 50."""
    limit = F.coalesce(F.col("limit_raw"), F.lit(str(DEFAULT_LIMIT)))
    error = F.coalesce(F.when(F.col("title").isNull(), "title_missing"),
                       limit_error(limit, MIN_LIMIT, MAX_LIMIT_SIMPLE))
    return requests.select("request_id", "title", F.col("title").alias("query"),
                           limit_value(limit).alias("limit"), error.alias("error"))


def resolved(requests: DataFrame, model: Model, profile: str) -> DataFrame:
    """Checked requests with ``status`` and, where found, ``source_id``; written once."""
    query = F.col("query")
    if profile == "production":
        checked = check_requests(requests).select("*", title_key(sanitise(query)).alias("key"))
    else:
        checked = check_requests_simple(requests).select("*", title_key(query).alias("key"))
    # Written here: every later stage reads plain columns instead of the validation chain.
    checked = materialise(checked.select("*", F.lower(query).alias("scan_key")), "checked")
    valid = checked.where(F.col("error").isNull())
    found = resolve(valid.select("request_id", "key", "scan_key"), model.titles, model.catalogue, model.title_index)
    status = (F.when(F.col("error").isNotNull(), "invalid_input")
              .when(F.col("source_id").isNull(), "not_found").otherwise("ok"))
    joined = checked.drop("key", "scan_key").join(found.select("request_id", "source_id"), "request_id", "left")
    return materialise(joined.select("*", status.alias("status")), "resolved")


def ranked_sources(answered: DataFrame, model: Model, profile: str) -> DataFrame:
    """``(source_id, rank, id, score)`` per distinct source book.

    Ranking once per source and cutting per request later keeps a very popular book from
    multiplying the scoring: thresholds and limits both keep a head of the ranked list.
    """
    books = book_keys(model.catalogue)
    ok = answered.where(F.col("status") == "ok")
    if profile == "simple":
        most = ok.agg(F.max("limit")).first()[0] or 1
        sources = ok.select("source_id").distinct()
        accepted = greedy(sources, model.vectors, books, most)
        return top(zero_fill(accepted, sources, model.vectors, books, most, profile), most)
    most, floor = ok.agg(F.max("limit"), F.min("threshold")).first()
    most = most or 1
    sources = ok.groupBy("source_id").agg(F.min("threshold").alias("floor"))
    own = materialise(works_of(sources.select("source_id", F.col("source_id").alias("id")), books), "own")
    found = top(scores(sources, model.vectors, profile, own, floor, keep=most), most).drop("rank")
    if floor is not None and floor <= 0.0:
        found = materialise(found, "found")
        zero_sources = sources.where(F.col("floor") <= 0.0).select("source_id")
        filled = zero_fill(found.join(zero_sources, "source_id", "left_semi"), zero_sources,
                           model.vectors, books, most, profile)
        found = found.join(zero_sources, "source_id", "left_anti").unionByName(filled)
    return top(found, most)


def recommend(requests: DataFrame, model: Model, profile: str = "production") -> DataFrame:
    """One row per recommendation; a request without any keeps one row with a null rank.
    A request without ``include_metadata`` gets the essential fields, the others are null.

    ``requests`` has ``request_id, title, limit_raw, threshold_raw, include_metadata``.
    """
    answered = resolved(requests, model, profile)
    plain = F.lit(True) if profile == "simple" else F.coalesce("include_metadata", F.lit(True))
    ranked = materialise(ranked_sources(answered, model, profile), "ranked")
    keep = F.col("rank") <= F.col("limit")
    if profile == "production":
        keep = keep & (F.col("score") >= F.col("threshold"))
    picked = answered.where(F.col("status") == "ok").join(ranked, "source_id").where(keep).select(
        "request_id", "rank", "id", "score", plain.alias("_all"))
    record = display(model.catalogue, profile).select(*RECORD)
    detailed = record.join(small(picked), "id").select(
        "request_id", "rank",
        *[F.col(c) if c in ESSENTIAL else F.when(F.col("_all"), F.col(c)).alias(c) for c in RECORD], shown_score(F.col("score")).alias("similarity_score"),
        reason(F.col("score"), profile).alias("reason"))
    head = answered.select("request_id", "title", "query", "status", "error", "source_id")
    out = head.join(detailed.withColumnRenamed("title", "rec_title"), "request_id", "left")
    if profile == "simple":
        # Fixed value: the message.
        message = F.when(F.col("status") == "not_found",
                         F.concat(F.lit('No books found matching "'), F.col("query"), F.lit('"')))
        out = out.withColumn("message", message)
    return out.withColumnRenamed("title", "asked").withColumnRenamed("rec_title", "title")


def neighbours(source_ids: DataFrame, model: Model, k: int, floor: float) -> DataFrame:
    """Ranked similar books for a table of book ids ``(id)``; ids not in the catalogue are skipped."""
    books = book_keys(model.catalogue)
    sources = source_ids.distinct().select(F.col("id").alias("source_id"))
    own = materialise(works_of(sources.select("source_id", F.col("source_id").alias("id")), books), "own")
    ranked = top(scores(sources, model.vectors, "production", own, floor, keep=k), k)
    return ranked.select("source_id", "rank", "id", "score", reason(F.col("score")).alias("reason"))

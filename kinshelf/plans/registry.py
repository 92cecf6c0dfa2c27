"""The registered queries: each takes ``(spark, folder)`` of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinshelf.functions import display as shown
from kinshelf.functions.display import search_record
from kinshelf.functions import screening, text, titles, validation
from kinshelf.functions.stop_words import ENGLISH
from kinshelf.operators import admission, duplicates, lookup, ranking, reports, scoring, search, tfidf
from kinshelf.params import DEFAULT_THRESHOLD, ModelParams, REQUEST_HISTORY, DEFAULT_MODEL
from kinshelf.plans import recommend as jobs
from kinshelf.plans.model import Model
from kinshelf.session import fresh_path, materialise, spread, work_dir
from kinshelf.sources import catalogue as cat
from kinshelf.sources import fixtures, request_log, snapshots
from kinshelf.sources.tables import live
from kinshelf.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY_SECONDS = 86_400
SHOWN_HITS = 10
GREEDY_ROWS = 20
ROWS_PER_FILE = 250_000  # of requests that arrive as files


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _view(spark, folder, name):
    return fixtures.view(spark, folder, name)


def _catalogue(spark, folder):
    return cat.load_catalogue(fixtures.views(spark, folder))


def snapshot_root(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/kinshelf/{spark.sparkContext.applicationId}/snapshots"


def model_of(spark: SparkSession, folder: str, params: ModelParams = DEFAULT_MODEL) -> Model:
    """The model of the catalogue, over whole descriptions; built once per state of the data."""
    catalogue = cat.load_catalogue(fixtures.views(spark, folder))
    return snapshots.load_or_build(fixtures.sources(spark, folder), catalogue, params, snapshot_root(spark))


def _labelled(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("id"))


def _labelled_sources(spark, folder, model):
    ids = _labelled(spark, folder).distinct()
    return model.catalogue.join(ids, "id", "left_semi").select(F.col("id").alias("source_id"))


def _labelled_scores(spark, folder, model):
    """Scores of the labelled books from the default threshold on; lower ones are not emitted."""
    sources = _labelled_sources(spark, folder, model)
    return scoring.scores(sources, model.vectors, "production", floor=DEFAULT_THRESHOLD)


def _documents(spark, folder):
    return tfidf.document_terms(_catalogue(spark, folder), DEFAULT_MODEL)


def _own(sources, books):
    return ranking.works_of(sources.select("source_id", F.col("source_id").alias("id")), books)


# Sources and sinks

@query
def src_tables(spark, folder):
    books = _view(spark, folder, "books_with_details")
    return books.select("id", "title", "slug", "average_rating", "rating_count", "language")


@query
def src_catalogue(spark, folder):
    return _catalogue(spark, folder)


@query
def src_catalogue_parts(spark, folder):
    return cat.load_catalogue(fixtures.part_catalogue(spark, folder))


@query
def snk_snapshot(spark, folder):
    catalogue, given = _catalogue(spark, folder), fixtures.sources(spark, folder)
    root = fresh_path(spark, "snapshots")
    snapshots.reload(given, catalogue, DEFAULT_MODEL, root)
    key = snapshots.key_for(given, DEFAULT_MODEL, root)
    found = snapshots.load(spark, root, key, DEFAULT_MODEL)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artefact"), "n")
              for name, df in found.tables().items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query
def src_snapshot(spark, folder):
    return model_of(spark, folder).catalogue.select("id", "title", "authors", "categories")


@query
def snk_requests(spark, folder):
    path = fresh_path(spark, "requests")
    request_log.append_requests(_view(spark, folder, "requests"), path)
    kept = request_log.read_requests(spark, path)
    return kept.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))


def _request_stream(spark, folder, times=1):
    path = fresh_path(spark, "stream_in")
    for _ in range(times):
        _view(spark, folder, "requests").repartitionByRange(8, "ts").write.mode("append").parquet(path)
    return request_log.stream_requests(spark, path)


@query
def src_requests_stream(spark, folder):
    """The log with every file delivered twice: repeated requests add no rows."""
    rows = streams.run_to_table(streams.unique_requests(_request_stream(spark, folder, 2)), "stream_rows")
    return rows.groupBy("status").agg(F.count("*").alias("n"))


# Filters and projections

@query
def flt_soft_delete(spark, folder):
    return live(_view(spark, folder, "books_with_details")).select("id", "language")


@query
def flt_eligible(spark, folder):
    return cat.eligible(live(_view(spark, folder, "books_with_details"))).select("id", "title")


@query
def prj_display(spark, folder):
    return shown.display(_catalogue(spark, folder))


@query
def prj_display_simple(spark, folder):
    return shown.display(_catalogue(spark, folder), "simple")


@query
def prj_search_hit(spark, folder):
    return shown.search_record(_catalogue(spark, folder))


@query
def prj_essential(spark, folder):
    rows = jobs.recommend(_view(spark, folder, "rec_requests"), model_of(spark, folder))
    asked = _view(spark, folder, "rec_requests").where(~F.col("include_metadata")).select("request_id")
    return rows.where(F.col("rank").isNotNull()).join(asked, "request_id", "left_semi").select(
        "request_id", *shown.ESSENTIAL)


@query
def flt_threshold(spark, folder):
    model = model_of(spark, folder)
    return _labelled_scores(spark, folder, model).groupBy("source_id").agg(F.count("*").alias("n"), F.min("score").alias("lowest"))


@query
def flt_not_self(spark, folder):
    model = model_of(spark, folder)
    return _labelled_scores(spark, folder, model).groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("id") == F.col("source_id")).alias("selves"))


@query
def flt_recent(spark, folder):
    requests = _view(spark, folder, "requests")
    return reports.recent(requests, reports.latest_time(requests), 1440).select("request_id", "status")


@query
def flt_has_error(spark, folder):
    return reports.with_error(_view(spark, folder, "requests")).select("request_id", "error_type")


@query
def flt_bot_agent(spark, folder):
    requests = _view(spark, folder, "requests")
    return requests.where(~screening.is_bot(F.col("user_agent"))).select("request_id", "user_agent")


@query
def flt_credential_format(spark, folder):
    requests = _view(spark, folder, "requests")
    return requests.select("request_id", screening.valid_key_format(F.col("api_key")).alias("valid"))


# Joins

@query
def join_left_links(spark, folder):
    t = fixtures.views(spark, folder)
    books = t["books_with_details"]
    authors = cat.book_links(books, t["book_authors"], "author_id").groupBy("id").agg(
        F.count("author_id").alias("authors"))
    categories = cat.book_links(books, t["book_categories"], "category_id").groupBy("id").agg(
        F.count("category_id").alias("categories"))
    return authors.join(categories, "id")


@query
def join_left_residual(spark, folder):
    t = fixtures.views(spark, folder)
    return cat.linked_names(t["book_authors"], t["authors"], "author_id")


@query
def join_fanout_star(spark, folder):
    return _catalogue(spark, folder).select("id", "authors", "categories")


@query
def join_postings(spark, folder):
    """The join of source and catalogue postings on the term, summed: the numerators of all scores that
    the labelled books have with books of their own author."""
    model = model_of(spark, folder)
    return scoring.posting_products(_labelled_sources(spark, folder, model), model.vectors).select(
        "source_id", "id", F.round("numerator", 6).alias("numerator"), "terms")


@query
def join_title_exact(spark, folder):
    model = model_of(spark, folder)
    keys = _find_keys(spark, folder)
    found = lookup.exact_matches(keys.select("key").distinct(), model.titles)
    return keys.join(found, "key").select("request_id", "source_id")


def _find_keys(spark, folder):
    key = titles.title_key(titles.sanitise(F.col("title")))
    return materialise(_view(spark, folder, "rec_requests").select("request_id", key.alias("key")), "keys")


@query
def join_title_contains(spark, folder):
    model = model_of(spark, folder)
    keys = _find_keys(spark, folder)
    found = model.title_index.containment_matches(keys, model.titles)
    return keys.join(found, "key").select("request_id", "source_id")


@query
def join_title_scan(spark, folder):
    model = model_of(spark, folder)
    checked = jobs.check_requests(_view(spark, folder, "rec_requests")).where(F.col("error").isNull())
    keys = materialise(checked.select("request_id", F.lower("query").alias("scan_key")), "scan_keys")
    found = model.title_index.scan_matches(keys)
    return keys.join(found, "scan_key").select("request_id", "source_id")


@query
def join_id_index(spark, folder):
    ids = _labelled(spark, folder)
    return ids.join(shown.display(_catalogue(spark, folder)), "id").select("id", "title", "authors")


@query
def join_hydrate(spark, folder):
    model = model_of(spark, folder)
    ranked = jobs.neighbours(_labelled(spark, folder), model, SHOWN_HITS, DEFAULT_THRESHOLD)
    return ranked.join(shown.display(model.catalogue), "id").select("source_id", "rank", *shown.RECORD)


@query
def join_not_duplicate(spark, folder):
    model = model_of(spark, folder)
    books = jobs.book_keys(model.catalogue)
    sources = _labelled_sources(spark, folder, model)
    own = materialise(_own(sources, books), "own")
    kept = scoring.scores(sources, model.vectors, "production", own, DEFAULT_THRESHOLD)
    return kept.groupBy("source_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


# Aggregations

@query
def agg_string_distinct(spark, folder):
    t = fixtures.views(spark, folder)
    return cat.name_list(t["book_authors"], t["authors"], "author_id", "authors")


@query
def agg_group_multi(spark, folder):
    books = _view(spark, folder, "books_with_details")
    return cat.group_books(books.join(_view(spark, folder, "book_authors"),
                                      F.col("id") == F.col("canonical_book_id")))


@query
def agg_term_tf(spark, folder):
    return tfidf.term_counts(_documents(spark, folder))


@query
def agg_term_df(spark, folder):
    return tfidf.term_stats(_documents(spark, folder))


@query
def agg_vocab_prune(spark, folder):
    books = _catalogue(spark, folder)
    stats = tfidf.term_stats(tfidf.document_terms(books, DEFAULT_MODEL))
    return tfidf.prune(stats, books.agg(F.count("*")).scalar(), DEFAULT_MODEL)


@query
def agg_l2_norm(spark, folder):
    """The norm of each book's weights before they are divided by it."""
    model = model_of(spark, folder)
    norms = tfidf.norms(_documents(spark, folder), model.vocab, DEFAULT_MODEL.max_features)
    return norms.select("id", "terms", F.round("norm", 6).alias("norm"))


@query
def agg_cosine(spark, folder):
    return _labelled_scores(spark, folder, model_of(spark, folder))


@query
def agg_title_index(spark, folder):
    return cat.titles_index(_catalogue(spark, folder))


def _performance(spark, folder, report, window):
    requests = _view(spark, folder, "requests")
    df = report(requests, reports.latest_time(requests), window)
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def agg_perf_stats(spark, folder):
    return _performance(spark, folder, reports.performance, 1440)


@query
def agg_perf_stats_hour(spark, folder):
    return _performance(spark, folder, reports.performance, 60)


@query
def agg_perf_stats_approx(spark, folder):
    return _performance(spark, folder, reports.performance_approx, 1440)


@query
def agg_error_breakdown(spark, folder):
    requests = _view(spark, folder, "requests")
    return reports.error_breakdown(requests, reports.latest_time(requests), 1440)


@query
def agg_popular(spark, folder):
    requests = _view(spark, folder, "requests")
    return reports.popular(requests, reports.latest_time(requests))


@query
def agg_lifetime_counters(spark, folder):
    return reports.lifetime_counters(_view(spark, folder, "requests"))


@query
def agg_fingerprint(spark, folder):
    return snapshots.data_fingerprint(_view(spark, folder, "books_with_details"))


@query
def agg_model_stats(spark, folder):
    return snapshots.model_stats(model_of(spark, folder))


# Ranking, windows, ordered state

@query
def win_rank_topk(spark, folder):
    return jobs.neighbours(_labelled(spark, folder), model_of(spark, folder), SHOWN_HITS, DEFAULT_THRESHOLD
                           ).select("source_id", "rank", "id", "score")


@query
def win_greedy_dedup(spark, folder):
    model = model_of(spark, folder)
    books = jobs.book_keys(model.catalogue)
    return ranking.greedy(_labelled_sources(spark, folder, model), model.vectors, books, GREEDY_ROWS)


@query
def win_zero_fill(spark, folder):
    model = model_of(spark, folder)
    books = jobs.book_keys(model.catalogue)
    sources = _labelled_sources(spark, folder, model)
    accepted = ranking.greedy(sources, model.vectors, books, GREEDY_ROWS)
    return ranking.zero_fill(accepted, sources, model.vectors, books, GREEDY_ROWS, "simple")


@query
def win_last_n(spark, folder):
    return reports.newest(_view(spark, folder, "requests"), REQUEST_HISTORY, "request_id").select("request_id", "status")


@query
def win_latest_row(spark, folder):
    return reports.host_health(_view(spark, folder, "host_metrics")).select(
        "host_id", "cpu_percent", "memory_percent", "memory_mb", "disk_usage_percent")


@query
def win_request_rate(spark, folder):
    rated = admission.request_rate(_view(spark, folder, "requests"))
    return rated.select("client", "request_id", "in_window")


@query
def win_rate_admission(spark, folder):
    return admission.rate_admission(_view(spark, folder, "requests"), 5, DAY_SECONDS)


@query
def win_topk_vocab(spark, folder):
    return model_of(spark, folder).vocab.select("term", "df", "ctf")


@query
def srt_catalogue(spark, folder):
    return _catalogue(spark, folder).select("id", "title").orderBy("id")


@query
def srt_scores(spark, folder):
    model = model_of(spark, folder)
    return _labelled_scores(spark, folder, model).orderBy("source_id", F.desc("score"), "id")


@query
def lim_search(spark, folder):
    model = model_of(spark, folder)
    hits = search.search_hits(_view(spark, folder, "search_requests"), model.catalogue, model.text_index)
    return hits.groupBy("request_id").agg(F.count("*").alias("found"), F.max("id").alias("last_id"))


@query
def lim_recommend(spark, folder):
    rows = jobs.recommend(_view(spark, folder, "rec_requests"), model_of(spark, folder))
    return rows.groupBy("request_id", "status").agg(F.count("rank").alias("total"))


@query
def srt_popular(spark, folder):
    requests = _view(spark, folder, "requests")
    return reports.popular(requests, reports.latest_time(requests), 25, 30 * 1440)


@query
def set_union_ngrams(spark, folder):
    return _documents(spark, folder).select("id", F.size("terms").cast("bigint").alias("terms"))


@query
def set_word_overlap(spark, folder):
    """All pairs of different books of one author that share enough words of their titles.

    Books of one author with the same words are one class; classes are compared, and their books put in last.
    """
    keys = jobs.book_keys(_catalogue(spark, folder))
    words = F.array_sort(titles.title_words(titles.plain_title(F.col("title_key"))))
    formed = keys.select("id", "author_key", words.alias("words"))
    books = materialise(formed.select("id", "author_key", "words", duplicates.work_key(F.col("author_key"), F.array_join("words", " ")).alias("work")), "formed")
    classes = materialise(spread(books.select("work", "author_key", "words").distinct()), "classes")
    size = classes.select("work", "words")
    both = duplicates.overlapping(classes, classes).where(F.col("left") <= F.col("right")).join(
        size.select(F.col("work").alias("left"), F.col("words").alias("a")), "left").join(
        size.select(F.col("work").alias("right"), F.col("words").alias("b")), "right")
    counted = materialise(both.select("left", "right", F.size("a").cast("bigint").alias("left_words"), F.size("b").cast("bigint").alias("right_words"),
                                      duplicates.shared_words(F.col("a"), F.col("b")).cast("bigint").alias("common")), "class_pairs")
    ids = books.select("work", "id")
    pairs = counted.join(ids.select(F.col("work").alias("left"), F.col("id").alias("left_id")), "left").join(
        ids.select(F.col("work").alias("right"), F.col("id").alias("right_id")), "right")
    ordered, first = F.col("left_id") < F.col("right_id"), F.col("left") != F.col("right")
    return pairs.where(ordered | (first & (F.col("left_id") > F.col("right_id")))).select(
        F.least("left_id", "right_id").alias("id"), F.greatest("left_id", "right_id").alias("other_id"),
        F.when(ordered, F.col("left_words")).otherwise(F.col("right_words")).alias("words"),
        F.when(ordered, F.col("right_words")).otherwise(F.col("left_words")).alias("other_words"), "common")


@query
def set_lookup_cascade(spark, folder):
    model = model_of(spark, folder)
    answered = jobs.resolved(_view(spark, folder, "rec_requests"), model, "production")
    return answered.select("request_id", "status", "error", "source_id")


@query
def set_distinct_id(spark, folder):
    ranked = jobs.neighbours(_labelled(spark, folder), model_of(spark, folder), SHOWN_HITS, DEFAULT_THRESHOLD)
    return ranked.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"))


# Scalar functions, each over a whole table

@query
def fn_clean_text(spark, folder):
    return _catalogue(spark, folder).select("id", text.clean_text(
        F.col("title"), F.col("description"), F.col("authors"), F.col("categories")).alias("clean"))


@query
def fn_clean_text_simple(spark, folder):
    return _catalogue(spark, folder).select("id", text.letters_only(
        F.col("title"), F.col("description"), F.col("authors"), F.col("categories")).alias("letters"))


def _letters(spark, folder):
    return _catalogue(spark, folder).select("id", text.letters_only(
        F.col("title"), F.col("description"), F.col("authors"), F.col("categories")).alias("letters"))


@query
def fn_tokenize(spark, folder):
    tokens = _letters(spark, folder).select("id", text.words(F.col("letters")).alias("t"))
    return tokens.select("id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@query
def fn_stop_words(spark, folder):
    tokens = _letters(spark, folder).select(
        "id", text.content_words(F.col("letters"), list(ENGLISH)).alias("t"))
    return tokens.select("id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@query
def fn_ngrams(spark, folder):
    tokens = _letters(spark, folder).select(
        "id", text.content_words(F.col("letters"), list(ENGLISH)).alias("t"))
    pairs = tokens.select("id", text.bigrams(F.col("t")).alias("b"))
    return pairs.select("id", F.array_join("b", ",").alias("bigrams"))


@query
def fn_idf(spark, folder):
    return model_of(spark, folder).vocab.select("term", F.round("idf", 6).alias("idf"))


@query
def fn_title_key(spark, folder):
    books = _view(spark, folder, "books_with_details")
    return books.select("id", titles.title_key(F.col("title")).alias("title_key"))


@query
def fn_sanitize(spark, folder):
    return _view(spark, folder, "rec_requests").select("request_id", titles.sanitise(F.col("title")).alias("clean"))


@query
def fn_validate_title(spark, folder):
    title = F.col("title")
    return _view(spark, folder, "rec_requests").select(
        "request_id", validation.title_error(title).alias("error"),
        F.when(validation.title_error(title).isNull(), validation.clean_title(title)).alias("clean"))


@query
def fn_validate_limit(spark, folder):
    raw = F.col("limit_raw")
    return _view(spark, folder, "rec_requests").select(
        "request_id", validation.limit_value(raw).alias("limit_value"), validation.limit_error(raw).alias("error"))


@query
def fn_validate_threshold(spark, folder):
    raw = F.col("threshold_raw")
    return _view(spark, folder, "rec_requests").select("request_id", validation.threshold_error(raw).alias("error"))


@query
def fn_validate_request(spark, folder):
    return validation.validate_requests(_view(spark, folder, "rec_requests"))


def _duplicates(spark, folder, profile):
    """For every labelled book, how many books of the same author count as the same work."""
    books = materialise(jobs.book_keys(_catalogue(spark, folder)), "books")
    sources = books.select("id").join(_labelled(spark, folder).distinct(), "id", "left_semi").select(
        F.col("id").alias("source_id"))
    blocked = duplicates.blocked_works(_own(sources, books), books, profile).groupBy("work").agg(F.count("*").alias("n"))
    work = duplicates.work_key(F.col("author_key"), F.col("title_key"))
    return books.withColumn("work", work).join(blocked, "work", "left").select("id", F.coalesce("n", F.lit(0)).alias("duplicate_of"))


@query
def fn_is_duplicate(spark, folder):
    return _duplicates(spark, folder, "production")


@query
def fn_is_duplicate_simple(spark, folder):
    return _duplicates(spark, folder, "simple")


@query
def fn_reason(spark, folder):
    scored = _labelled_scores(spark, folder, model_of(spark, folder))
    return scored.groupBy(shown.reason(F.col("score")).alias("production"),
                          shown.reason(F.col("score"), "simple").alias("simple")).agg(F.count("*").alias("n"))


@query
def fn_round_score(spark, folder):
    scored = _labelled_scores(spark, folder, model_of(spark, folder))
    return scored.groupBy(shown.shown_score(F.col("score")).alias("similarity_score")).agg(F.count("*").alias("n"))


@query
def fn_ellipsis(spark, folder):
    books = _catalogue(spark, folder)
    return books.select("id", shown.ellipsis(F.col("description"), 300, False).alias("when_longer"),
                        shown.ellipsis(F.col("description"), 200, True).alias("always"))


@query
def fn_multi_contains(spark, folder):
    model = model_of(spark, folder)
    return search.search_hits(_view(spark, folder, "search_requests"), model.catalogue, model.text_index)


@query
def fn_health_flags(spark, folder):
    samples = _view(spark, folder, "host_metrics")
    issues = screening.health_issues(F.col("cpu_percent"), F.col("memory_percent"), F.col("disk_usage_percent"))
    return samples.select(issues.alias("i")).groupBy(
        F.array_join("i", ",").alias("issues"), screening.health_status(F.col("i")).alias("status")
    ).agg(F.count("*").alias("n"))


@query
def fn_snapshot_key(spark, folder):
    fingerprint = snapshots.data_fingerprint(_view(spark, folder, "books_with_details"))
    return fingerprint.select(snapshots.snapshot_key(F.col("data_key"), F.lit(snapshots.config_hash(DEFAULT_MODEL))).alias("snapshot_key"))


@query
def fn_rates(spark, folder):
    requests = _view(spark, folder, "requests")
    report = reports.performance_approx(requests, reports.latest_time(requests), 1440)
    return report.select(*[F.round(c, 6).alias(c) for c in (
        "success_rate", "error_rate", "cache_hit_rate", "requests_per_minute")])


@query
def snap_valid(spark, folder):
    """Validity of one snapshot entry per request, aged like the requests."""
    requests = _view(spark, folder, "requests")
    names = F.array(*[F.lit(n) for n in Model.TABLES])
    manifest = requests.select(
        F.col("request_id").alias("snapshot_key"), F.col("ts").alias("created_at"),
        F.slice(names, 1, F.when(F.col("cache_hit"), 4).otherwise(3)).alias("artefacts"))
    return snapshots.valid_snapshots(manifest, reports.latest_time(requests)).select("snapshot_key")


# Jobs

@query
def job_build_model(spark, folder):
    model = model_of(spark, folder)
    return tfidf.postings(model.vectors, model.vocab).select("id", "term", F.round("weight", 6).alias("weight"))


RECOMMENDATION = ["request_id", "rank", *shown.RECORD, "similarity_score", "reason"]


@query
def job_recommend(spark, folder):
    rows = jobs.recommend(_view(spark, folder, "rec_requests"), model_of(spark, folder))
    return rows.select("asked", "query", "status", "error", "source_id", *RECOMMENDATION)


@query
def job_recommend_simple(spark, folder):
    rows = jobs.recommend(_view(spark, folder, "rec_requests"), model_of(spark, folder), "simple")
    return rows.select("query", "status", "error", "source_id", "message", *RECOMMENDATION)


@query
def job_neighbours(spark, folder):
    """The neighbours of every book of the catalogue."""
    model = model_of(spark, folder)
    return jobs.neighbours(model.catalogue.select("id"), model, SHOWN_HITS, DEFAULT_THRESHOLD)


@query
def job_search(spark, folder):
    model = model_of(spark, folder)
    return search.search(_view(spark, folder, "search_requests"), model.catalogue, index=model.text_index)


@query
def job_search_full(spark, folder):
    model = model_of(spark, folder)
    return search.search(_view(spark, folder, "search_requests"), model.catalogue, search_record, model.text_index)


@query
def job_find_title(spark, folder):
    return jobs.find_titles(_view(spark, folder, "rec_requests"), model_of(spark, folder))


@query
def job_reload(spark, folder):
    catalogue, given = _catalogue(spark, folder), fixtures.sources(spark, folder)
    root = fresh_path(spark, "snapshots")
    snapshots.load_or_build(given, catalogue, DEFAULT_MODEL, root)
    model = snapshots.reload(given, catalogue, DEFAULT_MODEL, root)
    return snapshots.model_stats(model)


@query
def job_request_report(spark, folder):
    """All figures of the last hour, the errors of the day and the popular titles."""
    requests = _view(spark, folder, "requests")
    as_of = reports.latest_time(requests)
    hour = reports.performance(requests, as_of, 60)
    figures = hour.unpivot([], [F.col(c).cast("double").alias(c) for c in hour.columns], "label", "value").select(
        F.lit("requests").alias("section"), "label", F.round("value", 6).alias("value"))
    errors = reports.error_breakdown(requests, as_of, 1440).select(
        F.lit("errors").alias("section"), F.col("error_type").alias("label"), F.col("errors").cast("double").alias("value"))
    best = reports.popular(requests, as_of).select(
        F.lit("popular").alias("section"), F.col("book_title").alias("label"), F.col("request_count").cast("double").alias("value"))
    return figures.unionByName(errors).unionByName(best)


@query
def job_screen_requests(spark, folder):
    requests = _view(spark, folder, "requests")
    admitted = admission.rate_admission(requests, 5, DAY_SECONDS)
    flags = requests.select(
        "request_id", validation.title_error(F.col("book_title")).alias("error"),
        screening.is_bot(F.col("user_agent")).alias("bot"),
        screening.valid_key_format(F.col("api_key")).alias("key_ok"))
    return flags.join(admitted, "request_id")


# Streams

@query
def str_perf_windows(spark, folder):
    rows = streams.run_to_table(streams.performance_windows(_request_stream(spark, folder)), "perf")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def str_error_counts(spark, folder):
    return streams.run_to_table(streams.error_windows(_request_stream(spark, folder)), "errors")


def _percentile_ranks(rows, requests):
    """``(window_start, below95, upto95, below99, upto99)``: requests below, and up to, the percentiles of their window.

    A percentile is ranked in each minute of its window and the ranks are summed, so that percentiles are
    repeated, as many as there are minutes, and requests are not.
    """
    nothing, minute = F.lit(None), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    timed = requests.select(minute, F.coalesce("duration_ms", F.lit(0.0)).alias("ms")).groupBy("minute", "ms").agg(F.count("*").alias("n")).select(
        "minute", "ms", "n", nothing.cast("timestamp_ntz").alias("window_start"), nothing.cast("int").alias("q"))
    every = F.explode(F.expr("sequence(window_start, window_start + interval 59 minutes, interval 1 minute)")).alias("minute")
    marks = F.inline(F.array(*[F.struct(F.col(f"p{q}_response_time_ms").alias("ms"), F.lit(q).alias("q")) for q in (95, 99)]))
    asked = rows.select("window_start", every, *[f"p{q}_response_time_ms" for q in (95, 99)]).select("window_start", "minute", marks).select(
        "minute", "ms", F.lit(0).cast("bigint").alias("n"), "window_start", "q")
    by_ms = Window.partitionBy("minute").orderBy("ms")
    upto = F.sum("n").over(by_ms.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("n").over(by_ms.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = timed.unionByName(asked).select("*", upto.alias("upto"), (upto - equal).alias("below")).where(F.col("q").isNotNull())
    return ranked.groupBy("window_start").agg(*[F.sum(F.when(F.col("q") == q, F.col(c))).alias(f"{c}{q}") for q in (95, 99) for c in ("below", "upto")])


@query
def str_perf_sliding(spark, folder):
    """Sixty minutes sliding by one; the percentiles as whether their ranks are within the sketch's error."""
    rows = streams.run_to_table(streams.performance_sliding(_request_stream(spark, folder)), "sliding")
    both = rows.join(_percentile_ranks(rows, _view(spark, folder, "requests")), "window_start")
    n, slack = F.col("requests_count"), streams.RANK_ERROR
    within = [((F.col(f"below{q}") <= (q / 100 + slack) * n + 1) & (F.col(f"upto{q}") >= (q / 100 - slack) * n - 1)).alias(f"p{q}_within")
              for q in (95, 99)]
    return both.select("window_start", "window_end", "requests_count", "successful_requests", "cache_hits",
                       *[F.round(c, 6).alias(c) for c in ("avg_response_time_ms", "min_response_time_ms", "max_response_time_ms",
                                                          "success_rate", "cache_hit_rate", "requests_per_minute")], *within)


@query
def str_popular(spark, folder):
    path = fresh_path(spark, "popular")
    streams.popular_stream(_request_stream(spark, folder), path).awaitTermination()
    return streams.kept_popular(spark, path)


@query
def str_rate_admission(spark, folder):
    return streams.run_to_table(
        streams.admission_stream(_request_stream(spark, folder), 5, DAY_SECONDS), "admission")


@query
def str_admission_ordered(spark, folder):
    """The live limiter over the files of four days each that arrive in a wrong order: what the watermark has passed.

    Four days are one file, or as many as their rows ask for, and arrive at once."""
    path = fresh_path(spark, "stream_in")
    rows = _view(spark, folder, "requests").withColumn("part", F.floor(F.dayofyear("ts") / 4) % 8)
    most = rows.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    files = -(-most // ROWS_PER_FILE)
    for part in (1, 0, 3, 2, 5, 4, 7, 6):
        chosen = rows.where(F.col("part") == part).drop("part")
        (chosen.coalesce(1) if files == 1 else chosen.repartition(files)).write.mode("append").parquet(path)
    source = request_log.stream_requests(spark, path, files)
    return streams.run_to_table(streams.admission_ordered(source, 5, DAY_SECONDS, "10 days"), "ordered", streams.ROCKS)


@query
def str_recommend(spark, folder):
    model = model_of(spark, folder)
    path = fresh_path(spark, "stream_requests")
    requests = _view(spark, folder, "rec_requests")
    requests.write.parquet(f"{path}/in")
    source = spark.readStream.schema(requests.schema).parquet(f"{path}/in")

    def sink(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    streams.recommend_stream(source, model, sink, f"{path}/state").awaitTermination()
    answers = spark.read.parquet(f"{path}/out")
    return answers.select("request_id", "status", "rank", "id", "similarity_score")

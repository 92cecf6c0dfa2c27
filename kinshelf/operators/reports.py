"""Reports on the request log and on host samples. Every report takes its own ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinshelf.functions.screening import health_issues, health_status
from kinshelf.operators.percentiles import exact_percentiles


def recent(requests: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Rows strictly newer than the start of the trailing window."""
    return requests.where(F.col("ts") > as_of - F.expr(f"interval {int(window_minutes)} minutes"))


def with_error(requests: DataFrame) -> DataFrame:
    return requests.where(F.length("error_type") > 0)


def latest_time(requests: DataFrame) -> Column:
    return requests.agg(F.max("ts")).scalar()


def _rates(total: Column, part: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(0.0)


def _base(recent_requests: DataFrame, window_minutes: int, extra: list[Column]) -> DataFrame:
    zero = F.lit(0.0)
    sums = recent_requests.agg(
        F.count("*").alias("requests_count"),
        F.count_if(F.col("status") == "success").alias("successful_requests"),
        F.coalesce(F.avg("duration_ms"), zero).alias("avg_response_time_ms"),
        F.coalesce(F.min("duration_ms"), zero).alias("min_response_time_ms"),
        F.coalesce(F.max("duration_ms"), zero).alias("max_response_time_ms"),
        F.count_if("cache_hit").alias("hits"), *extra,
    )
    n = F.col("requests_count")
    return sums.select(
        F.lit(window_minutes).cast("bigint").alias("window_minutes"), *[c for c in sums.columns if c != "hits"],
        _rates(n, F.col("successful_requests")).alias("success_rate"),
        _rates(n, n - F.col("successful_requests")).alias("error_rate"),
        _rates(n, F.col("hits")).alias("cache_hit_rate"),
        (n / window_minutes).alias("requests_per_minute"),
    )


def performance(requests: DataFrame, as_of: Column, window_minutes: int = 60) -> DataFrame:
    """Counts, response times with exact percentiles, and rates; zeros for an empty window."""
    rows = recent(requests, as_of, window_minutes)
    quantiles = exact_percentiles(rows, "duration_ms", [0.95, 0.99])

    def share(s: float) -> Column:
        picked = quantiles.agg(F.max(F.when(F.col("share") == s, F.col("percentile")))).scalar()
        return F.coalesce(picked, F.lit(0.0))

    return _base(rows, window_minutes, []).select(
        "*", share(0.95).alias("p95_response_time_ms"), share(0.99).alias("p99_response_time_ms"))


def performance_approx(requests: DataFrame, as_of: Column, window_minutes: int = 60,
                       accuracy: int = 10_000) -> DataFrame:
    """The same report in one pass, with sketched percentiles."""
    def sketch(share: float, name: str) -> Column:
        return F.coalesce(F.percentile_approx("duration_ms", share, accuracy), F.lit(0.0)).alias(name)

    return _base(recent(requests, as_of, window_minutes), window_minutes,
                 [sketch(0.95, "p95_response_time_ms"), sketch(0.99, "p99_response_time_ms")])


def error_breakdown(requests: DataFrame, as_of: Column, window_minutes: int = 60) -> DataFrame:
    return with_error(recent(requests, as_of, window_minutes)).groupBy("error_type").agg(
        F.count("*").alias("errors"))


def popular(requests: DataFrame, as_of: Column, limit: int = 10, window_minutes: int = 1440) -> DataFrame:
    """Most requested titles; equal counts go by first appearance."""
    counts = recent(requests, as_of, window_minutes).groupBy("book_title").agg(
        F.count("*").alias("request_count"), F.min(F.struct("ts", "request_id")).alias("first_seen"))
    return counts.orderBy(F.desc("request_count"), "first_seen").limit(limit).select("book_title", "request_count")


def lifetime_counters(requests: DataFrame) -> DataFrame:
    """``(counter, label, n)``: per status, per error type, cache hits and misses."""
    entries = F.array(
        F.struct(F.lit("status").alias("counter"), F.col("status").alias("label")),
        F.struct(F.lit("cache").alias("counter"), F.when(F.col("cache_hit"), "hit").otherwise("miss").alias("label")),
        F.struct(F.lit("error").alias("counter"), F.nullif(F.col("error_type"), F.lit("")).alias("label")),
    )
    tallies = requests.select(F.inline_outer(entries)).where(F.col("label").isNotNull())
    return tallies.groupBy("counter", "label").agg(F.count("*").alias("n"))


def newest(rows: DataFrame, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows: the history the service keeps."""
    return rows.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def host_health(samples: DataFrame) -> DataFrame:
    """Latest sample per host, of equal times the highest, with its issues and status."""
    facts = ["cpu_percent", "memory_percent", "memory_mb", "disk_usage_percent"]
    latest = samples.groupBy("host_id").agg(F.max(F.struct("ts", *facts)).alias("s")).select(
        "host_id", "s.*")
    issues = health_issues(F.col("cpu_percent"), F.col("memory_percent"), F.col("disk_usage_percent"))
    return latest.select("*", issues.alias("issues")).select("*", health_status(F.col("issues")).alias("status"))

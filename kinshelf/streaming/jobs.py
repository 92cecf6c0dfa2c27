"""Structured Streaming jobs over the request log."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinshelf.params import RATE_LIMIT_PER_MINUTE, RATE_WINDOW_SECONDS
from kinshelf.plans.model import Model
from kinshelf.plans.recommend import recommend
from kinshelf.session import folders, fresh_path, remove, runs_on_workers


def _windowed(requests: DataFrame, size: str, slide: str | None, delay: str, keys=()):
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), *keys)


def _bounds() -> list:
    return [F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end")]


def performance_windows(requests: DataFrame, size: str = "60 minutes", slide: str | None = None,
                        delay: str = "10 minutes") -> DataFrame:
    """Request statistics per event-time window. Rows later than the watermark are dropped."""
    stats = _windowed(requests, size, slide, delay).agg(
        F.count("*").alias("requests_count"),
        F.count_if(F.col("status") == "success").alias("successful_requests"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.avg("duration_ms").alias("avg_response_time_ms"),
        F.min("duration_ms").alias("min_response_time_ms"),
        F.max("duration_ms").alias("max_response_time_ms"),
        F.percentile_approx("duration_ms", 0.95).alias("p95_response_time_ms"),
        F.percentile_approx("duration_ms", 0.99).alias("p99_response_time_ms"),
    )
    n = F.col("requests_count")
    return stats.select(
        *_bounds(), *[c for c in stats.columns if c != "w"],
        (F.col("successful_requests") / n * 100).alias("success_rate"),
        ((n - F.col("successful_requests")) / n * 100).alias("error_rate"),
        (F.col("cache_hits") / n * 100).alias("cache_hit_rate"),
        (n * 60 / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("requests_per_minute"))


SKETCH_K = 200  # of the quantile sketches: a normalised rank error of about 1.65 % at most
RANK_ERROR = 0.0165


def performance_sliding(requests: DataFrame, size: str = "60 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Request statistics of a window that slides by ``slide``, each request aggregated once.

    Requests become one state per slide: counts, sums and a mergeable quantile sketch. Windows merge
    those states; a state, not a request, goes to every window it is in.
    """
    parts = _windowed(requests, slide, None, delay).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("good"), F.count_if("cache_hit").alias("hits"),
        F.sum("duration_ms").alias("total"), F.min("duration_ms").alias("low"), F.max("duration_ms").alias("high"),
        F.kll_sketch_agg_double(F.coalesce("duration_ms", F.lit(0.0)), SKETCH_K).alias("sketch"))
    merged = parts.groupBy(F.window(F.window_time("w"), size, slide).alias("w")).agg(
        F.sum("n").alias("requests_count"), F.sum("good").alias("successful_requests"), F.sum("hits").alias("cache_hits"),
        F.sum("total").alias("total"), F.min("low").alias("min_response_time_ms"), F.max("high").alias("max_response_time_ms"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    n = F.col("requests_count")
    return merged.select(
        *_bounds(), "requests_count", "successful_requests", "cache_hits", (F.col("total") / n).alias("avg_response_time_ms"),
        "min_response_time_ms", "max_response_time_ms",
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(q / 100)).alias(f"p{q}_response_time_ms") for q in (95, 99)],
        (F.col("successful_requests") / n * 100).alias("success_rate"), (F.col("cache_hits") / n * 100).alias("cache_hit_rate"),
        (n * 60 / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("requests_per_minute"))


def error_windows(requests: DataFrame, size: str = "60 minutes", delay: str = "10 minutes") -> DataFrame:
    counts = _windowed(requests.where(F.length("error_type") > 0), size, None, delay, ["error_type"]).agg(
        F.count("*").alias("errors"))
    return counts.select(*_bounds(), "error_type", "errors")


def title_windows(requests: DataFrame, size: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Counts per title and window; ``popular_windows`` ranks them once a window is closed."""
    counts = _windowed(requests, size, None, delay, ["book_title"]).agg(
        F.count("*").alias("request_count"), F.min("ts").cast("timestamp_ntz").alias("first_seen"))
    return counts.select(*_bounds(), "book_title", "request_count", "first_seen")


def popular_windows(counts: DataFrame, k: int = 10, keep_first_seen: bool = False) -> DataFrame:
    """Top titles of closed windows; a batch operator for ``foreachBatch`` or a written table."""
    best = Window.partitionBy("window_start").orderBy(F.desc("request_count"), "first_seen", "book_title")
    ranked = counts.select("*", F.row_number().over(best).cast("bigint").alias("rank")).where(F.col("rank") <= k)
    return ranked if keep_first_seen else ranked.drop("first_seen")


def merge_popular(path: str, batch: DataFrame, epoch: int, k: int = 10) -> None:
    """Merge the closed windows of one epoch into the kept top titles.

    An epoch writes its own folder, from the folder of the last epoch before it and its batch. Running an
    epoch again reads and writes the same folders, so it changes nothing; a reader takes the newest.
    """
    spark = batch.sparkSession
    before = [e for e in _epochs(spark, path) if e < epoch]
    counts = batch.select("window_start", "window_end", "book_title", "request_count", "first_seen")
    if before:
        counts = counts.unionByName(spark.read.schema(counts.schema).parquet(f"{path}/epoch={max(before)}"))
    best = popular_windows(counts.dropDuplicates(["window_start", "book_title"]), k, keep_first_seen=True)
    best.drop("rank").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    for old in sorted(before)[:-1]:
        remove(spark, f"{path}/epoch={old}")


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose folder is complete, by their names."""
    return sorted(int(name.partition("=")[2]) for name in folders(spark, path)
                  if name.startswith("epoch=") and "_SUCCESS" in folders(spark, f"{path}/{name}"))


def popular_stream(requests: DataFrame, path: str, k: int = 10, delay: str = "10 minutes") -> StreamingQuery:
    """Keep the top titles of every closed day under ``path``; ``kept_popular`` reads them."""
    return title_windows(requests, delay=delay).writeStream.foreachBatch(
        lambda batch, epoch: merge_popular(f"{path}/top", batch, epoch, k)).option(
        "checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def kept_popular(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """The top titles as of the newest complete epoch."""
    newest = max(_epochs(spark, f"{path}/top"))
    return popular_windows(spark.read.parquet(f"{path}/top/epoch={newest}"), k)


def unique_requests(requests: DataFrame, delay: str = "10 minutes", keep_for: str | None = None) -> DataFrame:
    """The stream without repeated request ids. An id is remembered until the watermark is ``delay`` past
    it, or ``keep_for`` where replays come later than late rows do; the state does not grow with time."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", keep_for or delay)
    return timed.dropDuplicatesWithinWatermark(["request_id"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def admission_stream(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                     window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """The live rate limiter. The state of a client is the times of its admitted requests in
    the window: at most ``limit`` numbers. Files must arrive in time order."""
    window = window_seconds * 1_000_000

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        flags = []
        for now in rows["us"]:
            kept = [t for t in kept if t >= now - window]
            flags.append(len(kept) < limit)
            if flags[-1]:
                kept.append(int(now))
        state.update((kept,))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "admitted": flags})

    timed = requests.select("client", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("client").applyInPandasWithState(
        decide, "client string, request_id bigint, admitted boolean", "kept array<bigint>",
        "append", GroupStateTimeout.NoTimeout)


CLIENT_BUCKETS = 512
ROWS = ["client", "us", "request_id"]


def _pack(frame: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(pack: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(pack)).read_pandas()


def _admit(us: np.ndarray, kept: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Whether each request of a client at ``us``, in order, is admitted, and the times admitted last. While
    the window is full the walk jumps to the first request after the oldest has left."""
    admitted, kept, i = np.zeros(len(us), bool), deque(kept), 0
    while i < len(us):
        while kept and kept[0] < us[i] - window:
            kept.popleft()
        if len(kept) < limit:
            admitted[i] = True
            kept.append(int(us[i]))
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(us, kept[0] + window, "right")) if kept else len(us))
    return admitted, list(kept)


class _Limiter(StatefulProcessor):
    """A bucket of clients of the ordered limiter: rows waiting for the watermark, and the admitted times in the window.

    Every call on a state or a timer is a message to Spark, and every element of a list is turned into
    bytes by itself. So clients share the state of their bucket, rows wait as packs, as they came, and a bucket
    has one timer, whose time it knows.
    """

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pack binary")
        self.held = handle.getValueState("held", "due bigint, kept binary")

    def handleInputRows(self, key, rows, timerValues):
        """Rows wait; one timer, at the earliest that waits, decides."""
        earliest = []
        for frame in rows:
            if len(frame):
                self.waiting.appendValue((_pack(frame[ROWS]),))
                earliest.append(int(frame["us"].min()))
        if earliest:
            due, kept = self.held.get() or (None, None)
            wake = min(earliest) // 1_000 + 1
            if due is None or wake < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(wake)
                self.held.update((wake, kept))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Decides what the watermark has passed, each client in order. Clients without waiting rows and without
        admitted times in the window are forgotten."""
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        packs, pack = [_unpack(w[0]) for w in self.waiting.get()], self.held.get()[1]
        times = {} if pack is None else {c: list(t) for c, t in zip(*[_unpack(pack)[n].tolist() for n in ("client", "us")], strict=True)}
        waiting = pd.concat(packs, ignore_index=True) if packs else pd.DataFrame({"client": [], "us": np.empty(0, np.int64), "request_id": []})
        ready, left = waiting[waiting["us"] < passed], waiting[waiting["us"] >= passed]
        code, names = pd.factorize(ready["client"], use_na_sentinel=False)
        order = np.lexsort((ready["request_id"].to_numpy(), ready["us"].to_numpy(), code))
        ready, code = ready.iloc[order], code[order]
        us, admitted = ready["us"].to_numpy(), np.zeros(len(ready), bool)
        for begin, end in pairwise(np.searchsorted(code, np.arange(len(names) + 1)).tolist()):
            client = None if pd.isna(names[code[begin]]) else names[code[begin]]
            admitted[begin:end], times[client] = _admit(us[begin:end], times.get(client, []), self.limit, self.window)
        times = {c: t for c, t in ((c, [x for x in t if x >= passed - self.window]) for c, t in times.items()) if t}
        if len(left):
            due = int(left["us"].min()) // 1_000 + 1
            if len(ready):
                self.waiting.put([(_pack(left),)])
        else:
            self.waiting.clear()
            due = (max(t[-1] for t in times.values()) + self.window) // 1_000 + 1 if times else None
        if due is None:
            self.held.clear()
        else:
            self.handle.registerTimer(due)
            self.held.update((due, _pack(pd.DataFrame({"client": list(times), "us": list(times.values())})) if times else None))
        if len(ready):
            yield pd.DataFrame({"client": ready["client"].to_numpy(), "request_id": ready["request_id"].to_numpy(), "admitted": admitted})

    def close(self) -> None:
        pass


def admission_ordered(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, window_seconds: int = RATE_WINDOW_SECONDS,
                      delay: str = "10 minutes") -> DataFrame:
    """The live rate limiter for rows that arrive out of order by at most ``delay``.

    Rows wait in the state of their bucket of clients until the watermark has passed them and are then decided
    client by client, in the order of time and request id, so the answer is that of the batch. Later rows are dropped.
    What a bucket keeps of a client is its waiting rows and at most ``limit`` times; timers forget idle clients. Needs
    the ``ROCKS`` state store.
    """
    timed = requests.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).select(
        F.pmod(F.xxhash64("client"), F.lit(CLIENT_BUCKETS)).alias("bucket"), "client", "request_id", "at", F.unix_micros("at").alias("us"))
    return timed.groupBy("bucket").transformWithStateInPandas(
        _Limiter(limit, window_seconds * 1_000_000), "client string, request_id bigint, admitted boolean", "append", "EventTime")


def recommend_stream(requests: DataFrame, model: Model, sink: Callable[[DataFrame, int], None],
                     checkpoint: str) -> StreamingQuery:
    """Answer a stream of title requests from a static model, batch by batch."""
    def answer(batch: DataFrame, epoch: int) -> None:
        sink(recommend(batch, model), epoch)

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, label: str, store: str | None = None) -> DataFrame:
    """Drain what the source holds now into a table in the work folder and read it back. ``store``
    names the state store of this query."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(STORE)
    if store:
        spark.conf.set(STORE, store)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


runs_on_workers(__name__)

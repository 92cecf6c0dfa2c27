"""Streams: replays, kept tops, forgotten clients, rows out of order."""

import datetime as dt
import random
import re
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from check_queries import compare, connect
from conftest import SMALL
from kinshelf.plans import registry
from kinshelf.plans.registry import QUERIES
from kinshelf.schemas import REQUESTS
from kinshelf.session import folders
from kinshelf.sources import request_log
from kinshelf.streaming import jobs
from test_jobs import limiter

START = dt.datetime(2024, 3, 1)


def requests(spark, rows):
    """rows: (request_id, seconds, client, title)"""
    names = [f.name for f in REQUESTS.fields]
    full = [{**dict.fromkeys(names), "request_id": i, "ts": START + dt.timedelta(seconds=s), "client": c, "book_title": t, "status": "success",
             "duration_ms": 1.0, "cache_hit": False} for i, s, c, t in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], REQUESTS)


@pytest.mark.parametrize("name", ["src_requests_stream", "str_popular", "str_perf_sliding", "str_admission_ordered"])
def test_streams_match_their_check_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name)[0].startswith("ok")


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "top")

    def batch(rows):
        return spark.createDataFrame([(START, START + dt.timedelta(days=1), t, n, START) for t, n in rows],
                                     "window_start timestamp_ntz, window_end timestamp_ntz, book_title string, request_count bigint, first_seen timestamp_ntz")

    def kept():
        return [(r["book_title"], r["rank"]) for r in jobs.kept_popular(spark, str(tmp_path), 2).orderBy("rank").collect()]

    jobs.merge_popular(path, batch([("a", 3), ("b", 9), ("c", 1)]), 0, 2)
    jobs.merge_popular(path, batch([("d", 5)]), 1, 2)
    assert kept() == [("b", 1), ("d", 2)]
    jobs.merge_popular(path, batch([("d", 5)]), 1, 2)
    assert kept() == [("b", 1), ("d", 2)]
    jobs.merge_popular(path, batch([]), 2, 2)
    assert kept() == [("b", 1), ("d", 2)] and "epoch=0" not in folders(spark, path)


def test_out_of_order_files_give_the_answer_of_the_batch_and_idle_clients_go(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4_000), rng.choice("abc"), "t") for i in range(300)] + [(900, 90_000, "z", "t"), (901, 90_001, "z", "t")]
    parts = [[r for r in rows[:300] if r[1] // 1_000 == k] for k in (1, 0, 3, 2)] + [rows[300:301], rows[301:]]
    for part in parts:
        requests(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.admission_ordered(request_log.stream_requests(spark, str(tmp_path / "in"), 1), 3, 60, "50 minutes")
    got = {r["request_id"]: r["admitted"] for r in jobs.run_to_table(stream, "ordered", jobs.ROCKS).collect()}
    assert got == limiter([(c, i, s * 1_000_000) for i, s, c, _ in rows[:300]], 3, 60_000_000)
    assert spark.streams.active == []


class Store:
    """The states and timers of one key; every call counts."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, [], None, set()

    def __getattr__(self, name):
        self.calls += 1
        return {"getListState": lambda *_: self, "getValueState": lambda *_: Value(self), "appendValue": self.rows.append,
                "appendList": self.rows.extend, "put": lambda rows: self.rows.__setitem__(slice(None), rows), "get": lambda: iter(list(self.rows)),
                "clear": self.rows.clear, "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name]


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls, self.store.value = self.store.calls + 1, value

    def clear(self):
        self.update(None)


def test_calls_on_the_state_do_not_grow_with_rows_and_clients():
    limiter_, store, rng = jobs._Limiter(3, 60_000_000), Store(), random.Random(5)
    limiter_.init(store)
    rows = [(rng.choice("abcdefgh"), rng.randrange(4_000) * 1_000_000, i) for i in range(3_000)]
    got, early = {}, {}
    for late in (False, True):
        part = [r for r in rows if (r[1] > 2_000_000_000) != late]
        list(limiter_.handleInputRows((0,), iter([pd.DataFrame(part, columns=["client", "us", "request_id"])]), None))
    assert len(store.timers) == 1
    for passed in (1_500_000, 3_000_000, 9_000_000):
        due = min(store.timers)
        store.timers.remove(due)
        for out in limiter_.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda p=passed: p), None):
            got |= dict(zip(out["request_id"].tolist(), out["admitted"].tolist(), strict=True))
        early = early or dict(got)
        assert due <= passed and len(store.timers) <= 1
    assert set(early) == {i for _, us, i in rows if us < 1_500_000_000}
    assert got == limiter([(c, i, us) for c, us, i in rows], 3, 60_000_000)
    assert store.calls < 50 and not store.rows and store.value is None and not store.timers


def test_four_days_of_several_files_arrive_at_once(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_PER_FILE", 60)
    triggers, whole = [], request_log.stream_requests
    monkeypatch.setattr(request_log, "stream_requests", lambda s, path, n: triggers.append((n, len(s.read.parquet(path).inputFiles()))) or whole(s, path, n))
    assert compare(spark, connect(SMALL), SMALL, "str_admission_ordered")[0].startswith("ok")
    assert triggers[0][0] > 1 and triggers[0][1] == 8 * triggers[0][0]


def test_expiry_deletes_whole_days(spark, tmp_path):
    path = str(tmp_path / "log")
    request_log.append_requests(requests(spark, [(i, i * 86_400, "a", "t") for i in range(5)]), path)
    assert request_log.expire_requests(spark, path, "2024-03-03") == ["date=2024-03-01", "date=2024-03-02"]
    assert request_log.read_requests(spark, path).agg(F.count("*")).first()[0] == 3
    assert request_log.expire_requests(spark, str(tmp_path / "none"), "2024-03-03") == []


def test_ranks_of_percentiles_do_not_repeat_requests(spark):
    plan = QUERIES["str_perf_sliding"](spark, SMALL)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+|*()\d-]*", line)[0]) for line in plan]
    for i, line in enumerate(plan):
        if "Generate explode" in line:
            below = [plan[j] for j in range(i + 1, len(plan)) if all(d > depth[i] for d in depth[i + 1:j + 1])]
            assert not any("events.parquet" in b for b in below)

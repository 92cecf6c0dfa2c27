"""Physical plans, the entry point, and a sample of queries against their check SQL."""

import inspect
import os
import shutil
import subprocess
import sys

import pyspark
import pytest
from pyspark.sql import functions as F

from check_queries import compare, connect
from conftest import SMALL
import __spark_entry__ as entry
from kinshelf import session
from kinshelf.operators import reports, scoring
from kinshelf.plans.registry import QUERIES
from kinshelf.sources import fixtures

NO_SQL = {"agg_perf_stats_approx"}



def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["job_neighbours", "job_search", "job_recommend", "src_catalogue", "win_request_rate"])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_top_k_is_cut_before_the_shuffle_and_scoring_pairs_blocks_without_the_driver(spark):
    text = plan(spark, "job_neighbours")
    assert "WindowGroupLimit" in text and "Partial" in text and "FlatMapCoGroupsInArrow" in text
    source = inspect.getsource(scoring)
    assert "toArrow" not in source and "collect(" not in source and "sparkContext" not in source


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "flt_soft_delete")
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_text_preparation_runs_once_per_use(spark):
    assert plan(spark, "agg_term_df").count("regexp_replace(") <= 4


def test_every_query_has_check_sql_or_is_known_not_to():
    assert set(QUERIES) - set(entry.oracle_sql()) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "job_recommend", "job_recommend_simple", "job_search", "job_find_title", "job_request_report", "agg_perf_stats", "agg_cosine",
    "set_word_overlap", "fn_title_key", "fn_snapshot_key", "str_perf_windows", "str_rate_admission", "src_catalogue_parts"])
def test_queries_match_their_check_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name)[0].startswith("ok")


def test_the_entry_point_opens_nothing_of_the_spark_distribution(tmp_path):
    bare = tmp_path / "pyspark"
    shutil.copytree(os.path.dirname(pyspark.__file__), bare, ignore=shutil.ignore_patterns("jars", "licenses", "examples", "data"))
    root = os.path.dirname(os.path.abspath(entry.__file__))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.oracle_sql()) > 90"],
                         env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True)
    assert run.returncode == 0, run.stderr.decode()


def test_sketched_report_is_close_to_the_exact_one(spark):
    requests = fixtures.view(spark, SMALL, "requests")
    as_of = reports.latest_time(requests)
    exact = reports.performance(requests, as_of, 43_200).first().asDict()
    near = reports.performance_approx(requests, as_of, 43_200).first().asDict()
    assert exact.keys() == near.keys() and exact["requests_count"] > 900
    for name, value in exact.items():
        assert near[name] == pytest.approx(value, rel=0.02 if name.startswith("p9") else 1e-12)


def test_an_empty_window_reports_zeros(spark):
    requests = fixtures.view(spark, SMALL, "requests")
    row = reports.performance(requests, F.lit("2030-01-01").cast("timestamp"), 60).first().asDict()
    assert row.pop("window_minutes") == 60 and set(row.values()) == {0}


def test_a_broadcast_is_bounded_in_rows_and_in_bytes(spark, monkeypatch):
    rows = spark.range(50).select("id", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"))

    def marked(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    assert marked(session.small(rows)) and not marked(session.small(rows, 49))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1_000)  # 50 ids have 400 bytes, with titles 1,190
    assert marked(session.small(rows.select("id"))) and not marked(session.small(rows))

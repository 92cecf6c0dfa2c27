"""The stored gram index against brute force, and its plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import make_books
from kinshelf.operators import lookup, search
from kinshelf.operators.gram_index import GramIndex
from kinshelf.sources.catalogue import titles_index


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["".join(rng.choices("abc é", k=rng.randint(0, 30))) for _ in range(70)] + ["", "a", "ab", "abc", "x" * 5_000]


def test_candidates_hold_every_true_pair(spark, texts, tmp_path):
    index = GramIndex.build(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), str(tmp_path / "i"), 4)
    needles = sorted({t[2:2 + k] for k, t in enumerate(texts[:30])} - {""} | {"zz", "abcabc" * 3, "b", "xx", "xxxx"})
    met = index.around(spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    got = {(r["needle"], r["id"]) for r in met.collect()}
    assert {(n, i) for n in needles for i, t in enumerate(texts) if n in t} <= got
    assert len(got) < len(needles) * len(texts) / 2
    hays = [t + " and more" for t in texts[:20]] + ["abc", "", "q"]
    met = index.within(spark.createDataFrame([(h,) for h in sorted(set(hays))], "hay string"), "hay")
    got = {(r["hay"], r["id"]) for r in met.collect()}
    assert {(h, i) for h in hays for i, t in enumerate(texts) if t in h} <= got


def test_lookup_reads_postings_where_they_lie(spark, texts, tmp_path):
    index = GramIndex.build(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), str(tmp_path / "i"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = index.around(spark.createDataFrame([("abc",), ("bca é",)], "needle string"), "needle")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    side = plan[plan.index("FileScan"):]
    assert "Bucketed: true" in side and "regexp_extract_all(text" not in plan
    assert not re.search(r"Exchange[^\n]*\n[^\n]*(Filter|FileScan)[^\n]*postings", plan)


def test_title_lookup_with_and_without_the_index(spark, tmp_path):
    rng = random.Random(5)
    words = ["Red", "blue ", "Door", "sea", "of", "x", "Élan", "the"]
    books = make_books(spark, [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), "d", "A", None) for i in range(1, 60)] + [(60, " ", "d", "A", None)])
    titles, index = titles_index(books), lookup.TitleIndex.build(books, str(tmp_path / "t"))
    asked = ["red door", "sea", "the red door of the sea x", "", "zz", "oo", "é", "blue  door", "x", "blue  sea of"]
    requests = spark.createDataFrame([(i, a.strip(), a) for i, a in enumerate(asked)], "request_id int, key string, scan_key string")
    plain = sorted(map(tuple, lookup.resolve(requests, titles, books).collect()))
    assert plain == sorted(map(tuple, lookup.resolve(requests, titles, books, index).collect())) and len(plain) > 5


def test_search_with_and_without_the_index(spark, shelf, tmp_path):
    index = search.text_grams(shelf, str(tmp_path / "s"))
    asked = spark.createDataFrame([(1, " NOVEL ", 2), (2, "", 5), (3, "story", 0), (4, "okada", 10), (5, "zzz", 5), (6, "o", 3), (7, "Sea", 9)],
                                  "request_id int, term string, hits bigint")
    plain = sorted(map(tuple, search.search_hits(asked, shelf).collect()))
    assert plain == sorted(map(tuple, search.search_hits(asked, shelf, index).collect())) and len(plain) > 6


def test_the_plan_of_a_lookup_holds_no_plan_of_its_stages(spark, tmp_path):
    shelf = spark.createDataFrame([(i, f"The {'red blue sea lamp'.split()[i % 4]} book {i}", f"a{i}") for i in range(30)], "id bigint, title string, authors string")
    titles = titles_index(shelf)
    index = lookup.TitleIndex.build(shelf, f"{tmp_path}/index")
    asked = [(1, "the red book 4", "The red book 4"), (2, "blue book 1", "blue"), (3, "zz", "LAMP BOOK 3"), (4, "no such", "no such"), (5, "yy", "lamp book 3")]
    requests = spark.createDataFrame(asked, "request_id int, key string, scan_key string")
    found = lookup.resolve(requests, titles, shelf, index)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("Join") <= 3
    got = {r.request_id: (r.source_id, r.stage) for r in found.collect()}
    assert got == {1: (4, 1), 2: (1, 2), 5: (3, 3)}

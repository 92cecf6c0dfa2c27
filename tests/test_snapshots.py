"""Digests per file, percentiles of awkward values, pairs of duplicate works, scoring in many blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinshelf.operators import duplicates, ranking, scoring
from kinshelf.operators.percentiles import exact_percentiles
from kinshelf.sources import digests


@pytest.fixture
def stored(spark, tmp_path):
    def write(name, rows, parts=3):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "id bigint, word string").repartition(parts).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return write, str(tmp_path / "store")


def entries(spark, store):
    return spark.read.parquet(f"{store}/entries").count()


def test_digest_knows_files_it_has_seen_and_ignores_layout(spark, stored):
    write, store = stored
    rows = [(i, "word%d" % (i % 7)) for i in range(200)] + [(None, None), (5, "word5"), (5, "word5")]
    first = digests.table_digest(write("a", rows), store)
    assert first.startswith("203_") and first == digests.table_digest(write("b", rows[::-1], 5), store)
    seen = entries(spark, store)
    assert first == digests.table_digest(spark.read.parquet(write("a2", rows).inputFiles()[0].rsplit("/", 1)[0]), store)
    again = entries(spark, store)
    assert first == digests.table_digest(write("a2", rows), store) and entries(spark, store) > again > seen
    assert digests.table_digest(write("c", rows[1:] + [(0, "other")]), store) != first
    assert digests.table_digest(write("d", rows[:0], 1), store).split("_") == ["0", "0"] or write("d", rows[:0], 1).count() == 0


def test_an_unchanged_state_reads_no_data(spark, stored, monkeypatch):
    write, store = stored
    table = write("a", [(i, "w") for i in range(50)])
    first = digests.table_digest(table, store)
    monkeypatch.setattr(digests, "_sums", lambda rows: pytest.fail("rows were hashed again"))
    assert digests.table_digest(table, store) == first
    listed = digests.listing(table)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listed and "BatchScan" not in listed


def test_only_a_new_file_is_hashed(spark, stored):
    write, store = stored
    table = write("a", [(i, "w") for i in range(50)])
    first = digests.table_digest(table, store)
    before = entries(spark, store)
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    spark.createDataFrame([(99, "new")], "id bigint, word string").coalesce(1).write.mode("append").parquet(path)
    second = digests.table_digest(spark.read.parquet(path), store)
    assert second != first and entries(spark, store) == before + 1
    assert digests.table_digest(spark.read.parquet(path), None) == second


@pytest.mark.parametrize("values", [
    [3.5] * 12_000, [0.0] * 11_000, [-2.0] * 6_000 + [7.0] * 6_000, [math.inf] * 11_000 + [float(i) for i in range(3_000)],
    [float(i % 977) for i in range(20_000)] + [math.inf, -math.inf, 1e308, -1e308, 5e-324]])
def test_percentiles_of_one_value_and_of_infinity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(values)
    for row in exact_percentiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        at = row["share"] * (len(order) - 1)
        a, b, part = order[math.floor(at)], order[math.ceil(at)], at - math.floor(at)
        expected = a if a == b or not part else (1 - part) * a + part * b
        assert row["percentile"] == expected or math.isclose(row["percentile"], expected, rel_tol=1e-12)


@pytest.mark.parametrize("profile,per_salt", [("production", 2_000), ("simple", 2_000), ("simple", 3)])
def test_same_works_equal_brute_force_with_a_hot_word(spark, monkeypatch, profile, per_salt):
    monkeypatch.setattr(duplicates, "WORKS_PER_SALT", per_salt)
    rng = random.Random(11)
    words = ["the", "the", "the", "sea", "wind", "lamp", "stone", "winter", "a", "art", "party"]
    works = sorted({(rng.choice("xy"), " ".join(rng.choices(words, k=rng.randrange(0, 7)))) for _ in range(70)})
    df = spark.createDataFrame(works, "author_key string, title_key string")
    left = duplicates.works_in(df.where(F.length("title_key") % 3 != 0))
    right = duplicates.works_in(df)
    names = {r["work"]: (r["author_key"], r["title_key"]) for r in right.collect()}
    got = {(names[r["left"]], names[r["right"]]) for r in duplicates.same_works(left, right, profile).collect()}

    def same(a, b):
        if a[0] != b[0]:
            return False
        common, wa, wb = len(set(a[1].split()) & set(b[1].split())), len(set(a[1].split())), len(set(b[1].split()))
        overlap = profile == "simple" and common >= 2 and (common / wa > 0.7 or common / wb > 0.7)
        return a[1] in b[1] or b[1] in a[1] or overlap

    assert got == {(a, b) for a in works if len(a[1]) % 3 for b in works if same(a, b)}


@pytest.mark.parametrize("keep", [None, 4])
def test_scores_in_many_blocks_equal_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(scoring, "BOOKS_PER_BLOCK", 9)
    monkeypatch.setattr(scoring, "BOOKS_PER_SLICE", 3)
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", 5)
    rng, books = random.Random(8), {}
    for i in range(60):
        raw = {t: rng.random() for t in rng.sample(range(20), rng.randrange(1, 6))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        books[i] = {t: w / norm for t, w in raw.items()}
    rows = [(i, [(t, w) for t, w in sorted(v.items())], max((w, t) for t, w in v.items())[1], f"t{i % 40}", "a") for i, v in books.items()]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    sources = vectors.select(F.col("id").alias("source_id"))
    own = vectors.select(F.col("id").alias("source_id"), "author_key", "title_key")
    found = scoring.scores(sources, vectors, "production", own, 0.05, keep=keep)
    got = {}
    for r in (found if keep is None else scoring.top(found, keep)).collect():
        got.setdefault(r["source_id"], []).append((-r["score"], r["id"]))

    def same(a, b):
        return f"t{a % 40}" in f"t{b % 40}" or f"t{b % 40}" in f"t{a % 40}"

    for s, v in books.items():
        scored = sorted((-round(sum(w * books[i].get(t, 0.0) for t, w in v.items()), 6), i) for i in books if i != s and not same(s, i))
        assert sorted(got.get(s, [])) == [x for x in scored if -x[0] >= 0.05][:keep]


def test_free_positions_equal_a_plain_walk(spark):
    rng = random.Random(2)
    taken = [(s, p) for s in range(6) for p in rng.sample(range(1, 41), 7 * s)]
    room = [(s, 3 * s + 1) for s in range(6)]
    got = {}
    for r in ranking.free_positions(spark.createDataFrame(taken, "source_id int, pos bigint"),
                                    spark.createDataFrame(room, "source_id int, room bigint"), 40).collect():
        got.setdefault(r["source_id"], []).append(r["pos"])
    for s, n in room:
        assert sorted(got.get(s, [])) == [p for p in range(1, 41) if (s, p) not in taken][:n]


@pytest.mark.parametrize("windows", [1, 3, 16])
def test_one_endless_run_is_walked_in_slices(spark, monkeypatch, windows):
    from kinshelf.operators import admission
    from test_jobs import limiter

    monkeypatch.setattr(admission, "WINDOWS_PER_WALK", windows)
    rng = random.Random(windows)
    rows = [("endless", i, i * 4_000_000 + rng.randrange(3) * 1_000_000) for i in range(400)]
    rows += [("even", 1_000 + i, i * 10_000_000) for i in range(120)] + [("calm", 2_000 + i, i * 90_000_000) for i in range(20)]
    df = spark.createDataFrame(rows, "client string, request_id bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: r.admitted for r in admission.rate_admission(df, 5, 60).collect()}
    assert got == limiter(rows, 5, 60_000_000)

"""Steps whose work grows no faster than their input: results against brute force, and sizes on the way."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, make_books
from kinshelf.functions import text
from kinshelf.operators import containment, duplicates, scoring, tfidf
from kinshelf.params import ModelParams
from kinshelf.plans.registry import QUERIES


@pytest.mark.parametrize("few", [50_000, 0])
def test_containment_of_two_large_sides_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 60))) for _ in range(80)]
    needles = sorted({t[2:2 + k] for k, t in enumerate(texts[:60])} | {"", "zz", "abcabc" * 3})
    hay = spark.createDataFrame([(i, "xy"[i % 2], t) for i, t in enumerate(texts)], "h int, author string, hay string")
    need = spark.createDataFrame([(n, "xy"[i % 2]) for i, n in enumerate(needles)], "needle string, author string")
    got = [(r.needle, r.h) for r in containment.contained(need, "needle", hay, "hay", ["author"]).collect()]
    assert sorted(got) == sorted((n, i) for k, n in enumerate(needles) for i, t in enumerate(texts) if n in t and k % 2 == i % 2)
    assert containment.contained(need.limit(0), "needle", hay, "hay", ["author"]).isEmpty()


@pytest.mark.parametrize("profile", ["production", "simple"])
def test_same_works_are_found_without_passes_over_the_catalogue(spark, monkeypatch, profile):
    monkeypatch.setattr(containment, "pass_count", None)
    works = duplicates.works_in(spark.createDataFrame([("a", "red sea"), ("a", "the red sea again"), ("b", "red sea")], "author_key string, title_key string"))
    assert duplicates.same_works(works, works, profile).count() == 5


def test_vectors_are_shuffled_once_whatever_the_number_of_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", 15)
    monkeypatch.setattr(scoring, "BOOKS_PER_BLOCK", 9)
    rows = [(i, [(i % 7, 0.6), (7 + i % 5, 0.8)], 7 + i % 5, f"t{i}", "a") for i in range(60)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    scored = scoring.scores(vectors.select(F.col("id").alias("source_id")), vectors, "production", floor=0.5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan and "FlatMapCoGroupsInArrow" not in plan
    weight = {i: dict(v) for i, v, *_ in rows}
    expected = {(i, j): round(sum(w * weight[j].get(t, 0) for t, w in weight[i].items()), 6) for i in weight for j in weight if i != j}
    assert {(r.source_id, r.id): r.score for r in scored.collect()} == {k: v for k, v in expected.items() if v >= 0.5}


@pytest.mark.parametrize("keep", [True, False])
def test_rare_terms_cost_products_only_where_a_book_and_a_source_share_them(monkeypatch, keep):
    rng, met = random.Random(5), []
    vectors = [{t: rng.randint(1, 9) / 10 for t in [*rng.sample(range(4), 2), *rng.sample(range(4, 4_000), 40)]} for _ in range(400)]
    as_vec = pa.array([[{"idx": t, "w": w} for t, w in sorted(v.items())] for v in vectors], pa.list_(pa.struct({"idx": pa.int32(), "w": pa.float64()})))
    books = pa.table({"id": pa.array(range(400)), "vec": as_vec, "work": pa.nulls(400, pa.string())})
    most = [(3, 50, 2_000)[i % 3] for i in range(200)]
    sources = pa.table({"source_id": pa.array(range(200)), "vec": as_vec.slice(0, 200), "bar": pa.array([0.2] * 200),
                        "most": pa.array(most), "home": pa.array([i == 9 for i in range(200)])})
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", 150)
    monkeypatch.setattr(scoring, "MET_AT_ONCE", 100)
    products, meet = scoring._Asked.products, scoring._Asked._meet
    monkeypatch.setattr(scoring._Asked, "_meet", lambda self, w, spot, *a: met.append(self.counts[spot].sum()) or meet(self, w, spot, *a))
    monkeypatch.setattr(scoring._Asked, "products", lambda self, w, spot, row, n, live: met.append(n * self.heavy.size) or products(self, w, spot, row, n, live))
    got = scoring._kernel(keep)(sources, books).to_pylist()
    dense = np.zeros((400, 4_000))
    for i, v in enumerate(vectors):
        dense[i, list(v)] = list(v.values())
    exact = np.round(dense[:200] @ dense.T, 6)
    expected = {(s, b): exact[s, b] for s in range(200) for b in range(400) if s not in (b, 9) and exact[s, b] >= 0.2}
    found = {(r["source_id"], r["id"]): r["score"] for r in got}
    assert len(found) == len(got) and all(expected[k] == pytest.approx(x, abs=1e-9) for k, x in found.items())
    if keep:
        for s, n in enumerate(most):
            rows = sorted((x for (a, _), x in expected.items() if a == s), reverse=True)
            assert sorted((x for (a, _), x in found.items() if a == s), reverse=True)[:n] == pytest.approx(rows[:n], abs=1e-9)
    else:
        assert set(found) == set(expected)
    assert sum(met) < 400 * 200 * 42 / 5  # of one product for each term of a book and each source


def test_the_best_scores_shuffle_vectors_once_too(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SOURCES_PER_GROUP", 15)
    monkeypatch.setattr(scoring, "BOOKS_PER_BLOCK", 9)
    rows = [(i, [(i % 7, 0.6), (7 + i % 5, 0.8 - i / 1000)], 7 + i % 5, f"t{i}", "a") for i in range(60)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    scored = scoring.scores(vectors.select(F.col("id").alias("source_id")), vectors, "production", floor=0.1, keep=4)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan and "FlatMapCoGroupsInArrow" not in plan
    weight = {i: dict(v) for i, v, *_ in rows}
    every = {i: [(-round(sum(w * weight[j].get(t, 0) for t, w in weight[i].items()), 6), j) for j in weight if i != j] for i in weight}
    expected = [(i, j, -s) for i, found in every.items() for s, j in sorted(found)[:4] if s <= -0.1]
    assert sorted((r.source_id, r.id, r.score) for r in scoring.top(scored, 4).collect()) == sorted(expected)


def test_word_overlap_compares_titles_and_not_their_copies(spark, monkeypatch):
    seen, whole = [], duplicates.overlapping
    monkeypatch.setattr(duplicates, "overlapping", lambda a, b: seen.append(a) or whole(a, b))
    rows = QUERIES["set_word_overlap"](spark, SMALL)
    assert seen[0].select("author_key", "words").distinct().count() == seen[0].count() and rows.count() > 0
    assert rows.select("id", "other_id").distinct().count() == rows.count() and rows.where("id >= other_id").isEmpty()


def test_numerators_are_summed_where_a_pair_is_met(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ROWS_PER_PIECE", 9)
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", 4)
    monkeypatch.setattr(scoring, "BOOKS_PER_SLICE", 5)
    rng = random.Random(7)
    rows = [(i, [(t, rng.random()) for t in sorted(rng.sample(range(12), rng.randint(1, 4)))], 0, f"t{i}", rng.choice(["a", "a", "b", None])) for i in range(80)]
    vectors = spark.createDataFrame([*rows, (99, [(3, 1.0)], 0, "t", "z")], "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    asked = spark.createDataFrame([(i,) for i in [*range(0, 80, 2), 0, 99, 500]], "source_id bigint")
    found = scoring.posting_products(asked, vectors)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Aggregate" in line or "Generate inline" in line for line in plan)
    got = {(r.source_id, r.id): (round(r.numerator, 9), r.terms) for r in found.collect()}
    expected = {}
    for i, a, _, _, x in rows[::2]:
        for j, b, _, _, y in rows:
            both = [w * dict(b)[t] for t, w in a if t in dict(b)]
            if i != j and x is not None and x == y and both:
                expected[i, j] = (round(sum(both), 9), len(both))
    assert got == expected and found.count() == len(expected)


def test_terms_take_one_pass_over_the_text(spark):
    rng = random.Random(9)
    words = ["the", "Sea", "sea", "a", "x1yy", "caf\u00e9s", "lamp-post", "\t", "of\n\n", "\u0130stanbul", "\u212aelvin", "\U0001f600zz", "\u00a0", "__", "\U0001d41aab"]
    books = make_books(spark, [(i, "".join(rng.choices([*words, " "], k=rng.randint(0, 30))), "Mid", "Ann|Bo", None) for i in range(60)])
    documents = tfidf.document_terms(books, ModelParams(stop_words=("the", "of")))
    letters = books.select("id", text.letters_only(F.col("title"), F.col("description"), F.col("authors"), F.col("categories")).alias("letters"))
    plain = letters.select("id", text.terms(text.content_words(F.col("letters"), ["the", "of"])).alias("terms"))
    assert sorted(map(tuple, documents.collect())) == sorted(map(tuple, plain.collect()))
    passes = documents._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert passes == 1


@pytest.mark.parametrize("keep", [None, 4])
def test_duplicates_are_left_out_where_they_would_be_scored(spark, monkeypatch, keep):
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", 11)
    monkeypatch.setattr(scoring, "BOOKS_PER_BLOCK", 9)
    monkeypatch.setattr(scoring, "BOOKS_PER_SLICE", 4)
    monkeypatch.setattr(scoring, "BLOCKED_PER_GROUP", 50)
    title = {i: f"tale {i % 10}" + " more" * (i % 3) for i in range(60)}
    rows = [(i, [(i % 7, 0.6), (7 + i % 5, 0.8 - i / 1000)], 7 + i % 5, title[i], "ab"[i % 2]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    own = vectors.select(F.col("id").alias("source_id"), "author_key", "title_key")
    scored = scoring.scores(own.select("source_id"), vectors, "production", own, 0.1, keep=keep)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "work" not in scored.columns
    weight = {i: dict(v) for i, v, *_ in rows}
    same = {(i, j) for i in weight for j in weight if i % 2 == j % 2 and (title[i] in title[j] or title[j] in title[i])}
    every = {i: [(-round(sum(w * weight[j].get(t, 0) for t, w in weight[i].items()), 6), j) for j in weight if (i, j) not in same] for i in weight}
    expected = [(i, j, -s) for i, found in every.items() for s, j in sorted(found)[:keep] if s <= -0.1]
    got = scored if keep is None else scoring.top(scored, keep)
    assert len(same) > 200 and sorted((r.source_id, r.id, r.score) for r in got.collect()) == sorted(expected)


def test_bars_and_home_blocks_shuffle_no_vectors_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SOURCES_PER_GROUP", 15)
    monkeypatch.setattr(scoring, "BOOKS_PER_BLOCK", 9)
    written, plans, store = [], {}, scoring.materialise
    monkeypatch.setattr(scoring, "materialise", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or written.append(name) or store(df, name))
    rows = [(i, [(i % 7, 0.6), (7 + i % 5, 0.8 - i / 1000)], 7 + i % 5, f"t{i}", "a") for i in range(60)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<idx:int,w:double>>, head int, title_key string, author_key string")
    among = vectors.where("id % 3 != 0 and head != 8")
    scored = scoring.scores(vectors.select(F.col("id").alias("source_id")), vectors, "production", floor=0.1, among=among, keep=4)
    assert "asked_at_home" not in written and plans["asked_pack"].count("RepartitionByExpression") == 2
    weight = {i: dict(v) for i, v, *_ in rows}
    every = {i: [(-round(sum(w * weight[j].get(t, 0) for t, w in weight[i].items()), 6), j) for j in weight if i != j and j % 3 and j % 5 != 1] for i in weight}
    expected = [(i, j, -s) for i, found in every.items() for s, j in sorted(found)[:4] if s <= -0.1]
    assert sorted((r.source_id, r.id, r.score) for r in scoring.top(scored, 4).collect()) == sorted(expected)

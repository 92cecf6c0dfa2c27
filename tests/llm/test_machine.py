"""The factorization machine against explicit sums over pairs, its bounds and its penalty."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from llm import toxicity


def test_scores_equal_sums_over_all_pairs():
    rng = np.random.default_rng(5)
    machine = toxicity.Machine(np.arange(12), -0.7, rng.normal(size=12), rng.normal(size=(12, 3)))
    held = rng.random((40, 12)) < 0.4
    text, term = np.nonzero(held)
    for row, score in zip(held, machine.scores(text, term, 40)):
        terms = np.flatnonzero(row)
        z = -0.7 + machine.linear[terms].sum()
        z += sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(terms) for b in terms[i + 1:])
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_sums_by_text_and_by_term_in_any_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    held = rng.random((30, 9)) < 0.3
    text, term = np.nonzero(held)
    mixed = rng.permutation(len(text))
    for block in (1, 7, 1 << 18):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        seen = toxicity.Occurrences(text[mixed], term[mixed], 30, 9)
        of_term, of_text = rng.random((9, 2)), rng.random((30, 3))
        assert np.allclose(seen.by_text(of_term.astype(np.float32)), held @ of_term, atol=1e-5)
        assert np.allclose(seen.by_term(of_text.astype(np.float32)), held.T @ of_text, atol=1e-5)


def test_chance_leaves_few_terms_and_few_alarms():
    """Labels drawn by chance, one in ten. Five draws kept 37 to 58 of 400 terms and raised 5 to 8 % alarms on new rows."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        text, term = np.nonzero(rng.random((300, 400)) < 0.05)
        machine = toxicity.fit(np.arange(400), text, term, (rng.random(300) < 0.1).astype(float))
        assert len(machine.without_zeros().terms) < 100
        text, term = np.nonzero(rng.random((2_000, 400)) < 0.05)
        assert (machine.scores(text, term, 2_000) >= toxicity.THRESHOLD).mean() < 0.1


def test_the_sample_is_bounded_by_rows_and_characters(spark):
    rng = random.Random(8)
    rows = [(i, "w" * rng.randrange(50, 150), i % 2) for i in range(400)] + [(5, "again", 1), (400, None, 0), (401, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    sizes = [len(r["text"] or "") for r in toxicity._sample(docs, docs, 50, 10**9).collect()]
    assert len(sizes) == 50
    sizes = [len(r["text"] or "") for r in toxicity._sample(docs, docs, 1_000, 2_000).collect()]
    assert 1 < len(sizes) and sum(sizes) <= 2_000
    assert toxicity._sample(docs, docs, 1_000, 0).count() >= 1
    none = docs.where("false")
    assert toxicity._sample(none, docs, 10, 10).count() == toxicity._sample(docs, none, 10, 10).count() == 0


def test_whole_rows_stay_beside_the_scores(spark):
    docs = spark.createDataFrame([(1, "a b", None, 2.0), (1, "a b", None, 2.0), (None, None, "x", 1.0)], "doc_id bigint, text string, lang string, score double")
    machine = toxicity.Machine(np.zeros(0, np.int64), -3.0, np.zeros(0), np.zeros((0, 2)))
    assert sorted(map(tuple, toxicity.drop_toxic(docs, machine).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert toxicity.drop_toxic(docs, toxicity.Machine(machine.terms, 3.0, machine.linear, machine.factors)).count() == 0
    plan = toxicity.drop_toxic(docs.where(F.col("lang").isNull()), machine)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan

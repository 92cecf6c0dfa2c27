"""Collision counting: recall against brute force, exact scores, edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from llm.collision_search import SortedProjections, search_nearest, threshold

SCHEMA = "vec_id bigint, embedding array<double>, key string, x int, asks string, score int"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, "z", 0) for i, v in rows], SCHEMA).repartition(3)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute(rows, asks, k):
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {i: sorted((-float((a * b).sum()), j) for j, b in usable if j != i and len(a) == len(b))[:k] for i, a in usable if asks(i)}


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = zip(*[(r["vec_id"], r["embedding"]) for r in df.collect()])
    ids, x = np.array(ids), np.array(x, float)
    for sizes in ((8_192, 4_096, 1_024), (200, 30, 16)):
        got = found(search_nearest(df, F.col("vec_id") % 20 == 0, 20, 48, *sizes))
        assert set(got) == set(ids[ids % 20 == 0].tolist())
        hits = 0
        for q, answer in got.items():
            scores = np.where(ids == q, -np.inf, (x * x[ids == q]).sum(1))
            assert [r for r, _, _ in answer] == list(range(1, 21))
            assert all(s == scores[ids == v][0] for _, v, s in answer)
            assert [(-s, v) for _, v, s in answer] == sorted((-s, v) for _, v, s in answer)
            hits += len({v for _, v, _ in answer} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        assert hits >= 0.95 * 20 * len(got)


def test_vectors_of_very_different_norms(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.uniform(-2, 2) for _ in range(8)]) for i in range(600)]
    got, expected = found(search_nearest(frame(spark, rows), F.col("vec_id") < 60, 10, 48, 100, 20, 8)), brute(rows, lambda i: i < 60, 10)
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v in answer}) for q, answer in expected.items())
    assert hits >= 0.95 * 600


def test_all_rows_where_there_are_fewer_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.25]), (2, [-1.0, 0.25]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
            (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, []), (9, [3.0]), (10, [-2.0]), (None, [1.0, 1.0]), (11, [0.5, 0.5]),
            (0, [1.0, 0.0])]
    got = found(search_nearest(frame(spark, rows), F.col("vec_id") >= 0, 20))
    expected = brute(rows, lambda i: True, 20)
    assert {q: [(v, s) for _, v, s in a] for q, a in got.items()} == {q: [(v, -s) for s, v in a] for q, a in expected.items() if a}
    assert search_nearest(frame(spark, []), F.col("vec_id") >= 0).count() == 0


def test_a_vector_that_most_rows_have(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(900 + i, [math.sin(i), math.cos(i), 0.5]) for i in range(300)]
    got = found(search_nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 5, 48, 64, 16, 8))
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[880]] == [0, 1, 2, 3, 4]


def test_windows_only_add_rows_and_end_with_all():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 5))
    index = SortedProjections(rows, float(np.sqrt((rows**2).sum(1)).max()), 12, 5)
    centre = rng.normal(size=12)
    low = high = index.at(centre, "left")
    counts = np.zeros(300, np.int64)
    for half in (0.1, 0.5, 2.0, 100.0):
        new_low, new_high = index.at(centre - half, "left"), index.at(centre + half, "right")
        counts += index.added(low, high, new_low, new_high)
        low, high = new_low, new_high
        assert counts.sum() == (high - low).sum()
    assert (counts == 12).all() and 1 <= threshold(12) <= 12

"""Vector codes against plain rounds, and the bounds against exact distances."""

import math

import numpy as np
from pyspark.sql import types as T

from check_queries import compare, connect
from conftest import SMALL
from llm.vector_codes import Bounds, code_report, compress, digest, squares

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.StringType()), T.StructField("v", T.StringType()), T.StructField("code", T.IntegerType()),
    T.StructField("error", T.StringType()), T.StructField("entry", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "y", 2) for i, v, l in rows], SCHEMA).repartition(3)


def plain(rows, parts, entries, rounds, scale):
    """``(vec_id, code, error, label_error, digest)`` with Python's integers, every distance looked at."""
    kept = [(i, [math.floor(x * scale) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for size in {len(v) for _, v, _ in kept}:
        mine = sorted((k for k in kept if len(k[1]) == size), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
        bounds = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
        books = [[v[a:b] for _, v, _ in mine[:entries]] for a, b in bounds]

        def name(v, books=books, bounds=bounds):
            return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], c)), e) for e, c in enumerate(book)) for (a, b), book in zip(bounds, books)]

        for _ in range(rounds):
            named = [[e for _, e in name(v)] for _, v, _ in mine]
            for p, (a, b) in enumerate(bounds):
                for e in range(len(books[p])):
                    held = [v[a:b] for (_, v, _), n in zip(mine, named) if n[p] == e]
                    if held:
                        books[p][e] = [sum(c) // len(held) for c in zip(*held)]
        sha = digest([np.array(book, object) for book in books])
        out += [(i, "".join(f"{e:02x}" for _, e in name(v)), min(sum(s for s, _ in name(v)), 2**63 - 1), l, sha) for i, v, l in mine]
    sums = {l: min(sum(r[2] for r in out if r[3] == l), 2**63 - 1) for l in {r[3] for r in out}}
    return sorted(((i, c, e, sums[l], s) for i, c, e, l, s in out), key=repr)


def check(spark, rows, parts=4, entries=256, rounds=4, scale=1_024):
    codes, _ = compress(frame(spark, rows), parts, entries, rounds, scale)
    got = sorted((tuple(r) for r in code_report(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert got == plain(rows, parts, entries, rounds, scale)
    return got


def test_query_matches_its_check_sql(spark):
    assert compare(spark, connect(SMALL), SMALL, "op12_vector_codes")[0].startswith("ok")


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], "ab"[i % 2]) for i in range(40)]
    rows += [(3, rows[3][1], None), (3, rows[3][1], None), (None, rows[5][1], "a"), (90, rows[7][1], "b")]  # repeats and ties
    rows += [(50, None, "a"), (51, [None] * 8, "a"), (52, [math.nan] * 8, "a"), (53, [math.inf] * 8, None), (54, [], "z"), (55, [1.0], "z"),
             (56, [0.5, -0.5, 2.0, 1.0, 3.0, 9.0], None), (57, [1.5, 0.5, 2.0, -1.0, 3.0, 9.0], None)]
    check(spark, rows, entries=6)
    check(spark, rows[:3])
    assert check(spark, []) == []


def test_components_beyond_exact_doubles(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 1e9, 4)], "a") for i in range(12)]
    check(spark, rows, entries=4)


def test_bounds_settle_most_rows_and_never_wrongly():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (24, 6))
    x = centres[rng.integers(0, 24, 3_000)] + rng.integers(-40, 40, (3_000, 6))
    history = [x[:24].copy()]
    bounds, scanned = Bounds.none(len(x)), []
    for _ in range(9):
        scanned.append(bounds.assign(x, history))
        away = squares(x, history[-1])
        assert (bounds.entry == away.argmin(1)).all()
        upper, lower = bounds.moved(history)
        others = np.sqrt(np.where(np.arange(24) == bounds.entry[:, None], np.inf, away))
        assert (upper >= np.sqrt(away.min(1)) - 1e-6).all() and (lower <= others.min(1) + 1e-6).all()
        history.append(np.array([x[bounds.entry == e].sum(0) // max((bounds.entry == e).sum(), 1) for e in range(24)]))
    assert scanned[0] == len(x) and sum(scanned[5:]) < len(x)


def test_net_displacement_is_tighter_than_summed_steps():
    there_and_back = [np.array([[0], [100]]), np.array([[9], [100]]), np.array([[1], [100]])]
    bounds = Bounds(np.array([0]), np.array([2.0]), np.array([0]), np.array([50.0]), np.array([0]))
    upper, lower = bounds.moved(there_and_back)
    assert upper[0] == 3.0 and lower[0] == 50.0  # the steps add up to 17

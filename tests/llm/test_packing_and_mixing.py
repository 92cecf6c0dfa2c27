"""Packing and mixing: exact round trips, targets by brute force, equal reruns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.cutting_stock import solve
from llm.mixing import mix, pivot, source_targets, take
from llm.packing import cuts, pack_documents
from llm.queries import tokenizer_path
from llm.tokens import Encoder

TEXTS = ["", "a", "Hello world, don't we'll  two  spaces \n\n x", "ünïcode élan “quotes” — dash", "x² ½ Ⅷ ٣ 中文 かな 😀🏽",
         "\x1c\x1d odd \x85 blanks here", "before<|endoftext|>after", "é" * 3000, "word " * 5000, "9" * 2000, "  lead", "_under_score_ 1_2"]


def test_encoder_equals_the_tokenizer():
    path = tokenizer_path()
    encoder, tokenizer = Encoder(path), Tokenizer.from_file(path)
    for text in TEXTS * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_covers_every_piece_with_little_waste(seed):
    rng = random.Random(seed)
    demand = {rng.randrange(1, 33) * 16: rng.randrange(1, 400) for _ in range(30)} | {k: 50 for k in range(1, 16)} | {1024: 7}
    plan, covered = solve(demand, 1024), Counter()
    for pattern, times in plan:
        assert sum(length * n for length, n in pattern.items()) <= 1024
        for length, n in pattern.items():
            covered[length] += n * times
    assert covered == Counter(demand)
    assert sum(t for _, t in plan) <= 1.02 * sum(a * n for a, n in demand.items()) / 1024 + 1
    assert solve({}, 1024) == [] and solve({5: 0}, 8) == []


def test_packing_is_an_exact_round_trip(spark):
    rows = [(i, t, 1, 1) for i, t in enumerate([None, *TEXTS])] + [(3, TEXTS[2], 1, 1), (3, TEXTS[2], 1, 1), (None, "no id", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int, length int")
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = pack_documents(docs, tokenizer_path(), sequence=64, grid=4).collect()
    by_sequence = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        times = sum(r[0] == doc_id for r in rows)
        assert [p["start"] for p in mine[::times]] == np.cumsum([0, *cuts(len(ids), 64, 4)])[:-1].tolist()
        assert np.frombuffer(b"".join(p["ids"] for p in mine[::times]), "<u4").tolist() == ids
        assert {p["doc_tokens"] for p in mine} == {len(ids)}
    carried = pack_documents(docs, tokenizer_path(), carry={"crc": F.crc32("ids")}).where("doc_id = 1").first()
    assert carried["crc"] == zlib.crc32(np.array([0], "<u4").tobytes())
    assert pack_documents(docs.where("false"), tokenizer_path()).count() == 0


def by_hand(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        above = {s for s in names if s not in full and left * weight[s] / rest > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        full |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500}, {"b": 5, "a": 7, "é": 900, "z": 0, None: 40, "Z": 3, "": 2}, {"a": 1, "b": 1, "c": 10_000, "d": 2},
])
def test_targets_equal_the_rule(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(by_hand(sizes))


def corpus(spark, n=900):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 40, 40, 300])), rng.choice(["a", "a", "a", "b", "c", None]), 0, 0) for i in range(n)]
    rows += [(n, None, "a", 0, 0), (n + 1, "", "empty", 0, 0), (None, "no id", "b", 0, 0), (5, *rows[5][1:]), (5, *rows[5][1:])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, copies int")


def test_mixing_meets_targets_and_reruns_agree(spark):
    docs = corpus(spark)
    rows = mix(docs, leaf_rows=50, fan_in=3).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=300)
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    again = mix(docs.repartition(7, "text"), leaf_rows=50, fan_in=3).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mix(docs.where("false")).count() == 0


def test_take_repeats_whole_rows(spark):
    docs = corpus(spark, 120)
    plan = {}
    for r in mix(docs).collect():
        plan[r["doc_id"], r["source"]] = plan.get((r["doc_id"], r["source"]), 0) + r["copies"]
    taken = take(docs)
    assert taken.columns == docs.columns
    assert Counter((r["doc_id"], r["source"]) for r in taken.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_pivoting_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 50, 40)
    total = np.zeros(40)
    for _ in range(4000):
        p = pivot(np.full(40, 0.3), size, rng.random(40))
        assert ((p == 0) | (p == 1)).sum() >= 39
        assert (p * size)[size > 0].sum() == pytest.approx(0.3 * size.sum())
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.05

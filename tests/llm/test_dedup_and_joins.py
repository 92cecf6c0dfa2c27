"""Exact dedup, near duplicates, components and exact search against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from check_queries import compare, connect
from conftest import SMALL
from llm.components import components
from llm.exact_dedup import drop_copies, exact_dedup
from llm.jaccard_join import drop_near_duplicates, near_duplicates
from llm.space import Space
from llm.topk_search import find, top_k

DOCS = "doc_id bigint, text string, kept boolean, salt int, n long"  # with names the operators use inside


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, 1, 2) for i, t in rows], DOCS).repartition(parts)


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "a  b\n"), (5, "a b "), (6, "a b"), (7, "a b"), (8, "A b"), (9, "x" * 300_000),
           (10, "x" * 300_000), (11, "a b"), (11, "a b"), (None, "a b"), (12, "solo"), (13, "\t\r\v\f"), (None, "null id")]


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_warc", "op10_topk_search"])
def test_queries_match_their_check_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name)[0].startswith("ok")


def test_exact_dedup_equals_brute_force(spark):
    groups = {}
    for i, t in AWKWARD:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        expected += [(i, keep, len(ids), i == keep, digest) for i in ids]
    got = [tuple(r) for r in exact_dedup(docs_of(spark, AWKWARD)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_exact_dedup_tells_texts_of_one_digest_apart(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "aa", "ac", "b", "ab", "z"])]
    one_letter = lambda c: F.substring(c, 1, 1)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs_of(spark, rows), key=one_letter).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1), 4: (4, 1), 5: (1, 2), 6: (6, 1)}


def test_exact_dedup_is_native(spark):
    plan = exact_dedup(docs_of(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_drop_copies_keeps_each_text_once_with_all_columns(spark):
    kept = drop_copies(docs_of(spark, AWKWARD))
    assert kept.columns == ["doc_id", "text", "kept", "salt", "n"]
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in AWKWARD})


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def linked_groups(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for (i, _), g in zip(rows, group):
        first[g] = min(x for x in (first.get(g), i) if x is not None)
    return sorted((i, len(s), first[g]) for (i, _), s, g in zip(rows, sets, group))


def noisy_corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:  # an edited copy, so that chains of links arise
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.75:
            words = passage + rng.choices(vocabulary, k=rng.randrange(1, 14))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 30, 60, 200]))
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = noisy_corpus(seed) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One TWO"), (1004, "one\ttwo"), (1005, "É f"), (1006, "é f")]
    got = near_duplicates(docs_of(spark, rows))
    assert sorted(tuple(r)[:3] for r in got.collect()) == linked_groups(rows)


def test_near_copies_of_more_shingles_than_16_bits_count(spark):
    words = [f"u{k}" for k in range(70_000)]
    edited = words[:]
    edited[35_000] = "other"
    rows = [(0, " ".join(words)), (1, " ".join(edited))] + [(i + 2, t) for i, t in noisy_corpus(7, 40)]
    got = near_duplicates(docs_of(spark, rows, parts=1).sortWithinPartitions("doc_id"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == linked_groups(rows)


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    rows = noisy_corpus(3, 60) + [(500, None), (501, "")]
    rows += [rows[4], (4, rows[4][1] + " more")]
    kept = drop_near_duplicates(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "salt", "n"]
    groups = {g for i, n, g in linked_groups(rows) if n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups | {500, 501})


def test_joins_of_an_empty_table(spark):
    none = docs_of(spark, AWKWARD).where("false")
    assert exact_dedup(none).count() == drop_copies(none).count() == 0
    assert near_duplicates(none).count() == drop_near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    group = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == group


def test_search_equals_brute_force_with_ties_and_unusable_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0]), (402, [float("nan")] * 3), (403, [float("inf"), 0.0, 0.0]), (404, [1.0, 1.0]),
             (405, [0.5, 0.5]), (406, []), (None, [1.0, 1.0, 1.0]), (20, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank int")
    usable = [(i, [int(256 * x // 1) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and abs(x) < 1e9 for x in v)]
    expected = []
    for q, a in usable:
        if q % 20 == 0 or q == 404:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
            expected += [(q, scored)]
    got = {}
    asks = (F.col("vec_id") % 20 == 0) | (F.col("vec_id") == 404)
    for r in top_k(df, asks, 5, shard_rows=64, query_rows=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    by_id = {}
    for q, scored in expected:  # an id with two vectors asks with both
        by_id[q] = sorted(set(by_id.get(q, [])) | set(scored))
    assert len(by_id) == len(expected) - 1
    for q, scored in by_id.items():
        assert sorted(got.get(q, [])) == [(k + 1, *s) for k, s in enumerate(scored[:5])], q


def test_search_with_a_repeated_query_and_a_repeated_row(spark):
    rows = [(0, [1.0]), (0, [1.0]), *[(i, [1.0 - i / 16]) for i in range(1, 9)], (2, [1.0 - 2 / 16])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [r["vec_id"] for r in top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [1, 2, 2, 3, 4]


def test_search_sends_questions_only_where_the_bound_reaches_the_bar(spark):
    rng = random.Random(9)
    hubs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in hubs[i % 12]]) for i in range(1_200)] + [(2_000 + i, hubs[0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<double>").withColumn("asks", F.col("vec_id") % 10 == 0)
    space = Space(df, 5, 64, 32, 64)
    assert space.points.count() == 1_201 and max(space.pieces.values()) <= 2  # equal vectors are one point
    first = space.search(space.homes().withColumn("bar", F.lit(float("-inf"))), find, "double")
    sent = space.routed(space.barred(first))
    assert 0 < sent.count() < space.asked.count() * sum(space.pieces.values()) / 3
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    got = {}
    for r in top_k(df.withColumnRenamed("x", "embedding"), F.col("vec_id") % 10 == 0, 5, 64, 32, 64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for q, a in whole[::10]:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, *s) for n, s in enumerate(scored)]


def test_search_of_huge_components_and_of_nothing(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, -(2**63))]
    assert top_k(df.where("false"), F.col("vec_id") == 0).count() == 0

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_books
from kinshelf.operators import admission, containment, lookup, ranking, scoring, search, tfidf
from kinshelf.operators.percentiles import exact_percentiles
from kinshelf.params import ModelParams
from kinshelf.plans import recommend as jobs
from kinshelf.plans.model import build_model
from kinshelf.sources import snapshots
from kinshelf.sources.catalogue import titles_index

FIVE = ModelParams(max_features=100, min_df=1, max_df=0.9)


@pytest.fixture(scope="module")
def five(shelf):
    return build_model(shelf, FIVE)


@pytest.fixture(scope="module")
def crowd(spark):
    """Sixty books of few authors with overlapping titles, some without any term."""
    rng = random.Random(7)
    words = ["river", "stone", "garden", "winter", "silent", "crown", "glass", "ember"]
    rows = []
    for i in range(1, 61):
        title = " ".join(rng.sample(words, rng.randint(1, 4)))
        text = " ".join(rng.choices(words, k=rng.randint(0, 6))) if i % 9 else "12 34"
        title = title if i % 9 else f"{i}"
        rows.append((i, title, text or "none", rng.choice(["A", "B", None]) if i % 9 else None, None))
    return rows, build_model(make_books(spark, rows), ModelParams(max_features=50, min_df=1, max_df=1.0))


def cosines(model):
    vec = {r.id: {x.idx: x.w for x in r.vec} for r in model.vectors.collect()}
    ids = [r.id for r in model.catalogue.select("id").collect()]
    return {(a, b): round(sum(w * vec.get(b, {}).get(i, 0.0) for i, w in vec.get(a, {}).items()), 6)
            for a in ids for b in ids if a != b}


def forms(rows):
    out = {}
    for i, title, _, author, _ in rows:
        plain = "".join(c for c in title.lower().strip() if c.isalnum() or c in "_ ")
        out[i] = ((author or "Unknown").lower(), plain, set(plain.split()))
    return out


def alike(a, b):
    if a[0] != b[0]:
        return False
    common = len(a[2] & b[2])
    return a[1] in b[1] or b[1] in a[1] or (
        common >= 2 and (common / len(a[2]) > 0.7 or common / len(b[2]) > 0.7))


def walk(source, cos, form, limit):
    order = sorted((i for s, i in cos if s == source), key=lambda i: (-cos[source, i], i))
    kept = []
    for i in order:
        if not alike(form[i], form[source]) and not any(alike(form[i], form[k]) for k in kept):
            kept.append(i)
            if len(kept) == limit:
                break
    return kept


def test_vectors_have_unit_length_and_known_weights(five):
    for row in five.vectors.collect():
        assert abs(sum(x.w ** 2 for x in row.vec) - 1) < 1e-9
    vocab = {r.term: r for r in five.vocab.collect()}
    assert vocab["novel"].df == 4 and vocab["novel"].ctf == 5
    assert abs(vocab["novel"].idf - (math.log(6 / 5) + 1)) < 1e-12
    assert "story storms" in vocab  # the bigram bridges a removed stop word


def test_documents_are_counted_where_they_lie(spark, five):
    documents = tfidf.document_terms(five.catalogue, FIVE)
    for counted in (tfidf.term_counts(documents), tfidf.norms(documents, five.vocab, FIVE.max_features), tfidf.vectors(documents, five.vocab, FIVE.max_features)):
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"])], "id bigint, terms array<string>")
    assert {tuple(r) for r in tfidf.term_counts(odd).collect()} == {(1, "a", 1), (1, "b", 2), (4, "a", 1)}
    vocab = spark.createDataFrame([(0, "b", 1, 2, 2.0), (1, "c", 1, 1, 1.0)], "idx int, term string, df bigint, ctf bigint, idf double")
    for most in (10, 2_000_000):
        assert [tuple(r) for r in tfidf.norms(odd, vocab, most).collect()] == [(1, 1, 4.0)]


def test_empty_vocabulary_is_an_error(shelf):
    with pytest.raises(ValueError):
        build_model(shelf, ModelParams(min_df=50))


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, title string, limit_raw string, threshold_raw string, include_metadata boolean")


def test_recommend_statuses(spark, five):
    rows = jobs.recommend(requests(spark, [
        (1, "THE HARBOUR LAMP", "3", "0.0", None), (2, "Zeppelin Atlas", None, None, None), (3, "The Keeper's Song", None, None, None),
        (4, "orchards", "5", "0.0", False), (5, "2077", "0", None, None), (6, "  the  clock under the stairs and more ", None, None, None),
    ]), five).collect()
    bare = [r for r in rows if r.request_id == 4]
    assert bare and all(r.title and r.reason and r.slug is None and r.description is None and r.rating is None for r in bare)
    assert all(r.description for r in rows if r.request_id == 1)
    status = {r.request_id: (r.status, r.source_id) for r in rows}
    assert status == {1: ("ok", 1), 2: ("not_found", None), 3: ("invalid_input", None), 4: ("ok", 3),
                      5: ("invalid_input", None), 6: ("ok", 4)}
    first = sorted((r.rank, r.id, r.similarity_score) for r in rows if r.request_id == 1)
    assert [r for r, _, _ in first] == [1, 2, 3]
    assert all(a[2] >= b[2] for a, b in zip(first, first[1:]))


def test_last_of_equal_titles_wins_and_first_sets_the_order(spark):
    books = make_books(spark, [(1, "Blue Door", "x", "A", None), (2, "Red Door", "y", "A", None), (3, "blue door ", "z", "B", None)])
    titles = titles_index(books)
    asked = spark.createDataFrame([(1, "blue door", "blue door"), (2, "door", "door"), (3, "a red door here", "-"),
                                   (4, "", ""), (5, "green", "green")], "request_id int, key string, scan_key string")
    got = {r.request_id: (r.source_id, r.stage) for r in lookup.resolve(asked, titles, books).collect()}
    assert got == {1: (3, 1), 2: (3, 2), 3: (2, 2), 4: (3, 2)}


def test_third_stage_sees_inner_white_space(spark):
    books = make_books(spark, [(1, "Long  gap title", "x", "A", None)])
    asked = spark.createDataFrame([(1, "long gap", "long  gap")], "request_id int, key string, scan_key string")
    got = lookup.resolve(asked, titles_index(books), books).first()
    assert (got.source_id, got.stage) == (1, 3)


@pytest.mark.parametrize("passes", [1, 3])
def test_containment_joins_equal_brute_force(spark, monkeypatch, passes):
    monkeypatch.setattr(containment, "pass_count", lambda *a: passes)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 60))) for _ in range(80)]
    needles = [t[2:2 + k] for k, t in enumerate(texts[:40])] + ["", "zz", "abcabc" * 3]
    hay = spark.createDataFrame(list(enumerate(texts)), "h int, hay string")
    need = spark.createDataFrame([(n,) for n in sorted(set(needles))], "needle string")
    expected = {(n, i) for n in set(needles) for i, t in enumerate(texts) if n in t}
    small = set()
    for part in containment.needles_in_haystacks(need, "needle", "needle", hay, "hay"):
        small |= {(r.needle, r.h) for r in part.collect()}
    large = set()
    for part in containment.haystacks_around_needles(hay, "hay", "hay", need, "needle"):
        large |= {(r.needle, r.h) for r in part.collect()}
    assert small == expected and large == expected


@pytest.mark.parametrize("per_pass", [4000, 7])
def test_scores_equal_brute_force_in_any_number_of_passes(spark, crowd, monkeypatch, per_pass):
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", per_pass)
    rows, model = crowd
    sources = model.catalogue.select(F.col("id").alias("source_id"))
    got = {(r.source_id, r.id): r.score for r in scoring.scores(sources, model.vectors, "production").collect()}
    expected = {k: v for k, v in cosines(model).items() if v > 0}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 2e-6 and got[k] == got[k[1], k[0]] for k, v in expected.items())
    best = scoring.top(scoring.scores(sources, model.vectors, "production", keep=3), 3).collect()
    for s in {k[0] for k in expected}:
        order = sorted((i for a, i in got if a == s), key=lambda i: (-got[s, i], i))[:3]
        assert [r.id for r in sorted((r for r in best if r.source_id == s), key=lambda r: r.rank)] == order


@pytest.mark.parametrize("depth,head", [(256, 256), (2, 3)])
def test_greedy_and_zero_fill_equal_a_plain_walk(spark, crowd, monkeypatch, depth, head):
    monkeypatch.setattr(ranking, "FOLD_DEPTH", depth)
    monkeypatch.setattr(ranking, "FIRST_HEAD", head)
    rows, model = crowd
    books = jobs.book_keys(model.catalogue)
    picked = [3, 9, 18, 27, 31, 44, 60]
    sources = spark.createDataFrame([(i,) for i in picked], "source_id bigint")
    accepted = ranking.greedy(sources, model.vectors, books, 8)
    filled = ranking.zero_fill(accepted, sources, model.vectors, books, 8, "simple").collect()
    cos, form = cosines(model), forms(rows)
    for s in picked:
        got = [r.id for r in sorted((r for r in filled if r.source_id == s), key=lambda r: (-r.score, r.id))]
        assert got == walk(s, cos, form, 8)


def test_zero_fill_production(spark, crowd, monkeypatch):
    monkeypatch.setattr(ranking, "FIRST_HEAD", 4)
    rows, model = crowd
    got = jobs.recommend(requests(spark, [(1, "9", "40", "0.0", None)]), model).collect()
    cos = cosines(model)
    form = {i: ((a or "Unknown").lower(), t.lower().strip()) for i, t, _, a, _ in rows}
    source = got[0].source_id
    free = [i for i in form if i != source and not (
        form[i][0] == form[source][0] and (form[i][1] in form[source][1] or form[source][1] in form[i][1]))]
    expected = sorted(free, key=lambda i: (-cos[source, i], i))[:40]
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == expected


def test_search(spark, shelf):
    asked = spark.createDataFrame([(1, " NOVEL ", 2), (2, "", 5), (3, "story", 0), (4, "okada", 10), (5, "zzz", 5)],
                                  "request_id int, term string, hits bigint")
    got = {}
    for r in search.search_hits(asked, shelf).collect():
        got.setdefault(r.request_id, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 3], 3: [1], 4: [4]}


def limiter(rows, limit, window):
    state, flags = {}, {}
    for client, i, us in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        kept = [t for t in state.get(client, []) if t >= us - window]
        flags[i] = len(kept) < limit
        state[client] = kept + [us] if flags[i] else kept
    return flags


def test_rate_admission_equals_a_plain_limiter_with_a_hot_client(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for client, n, span in (("hot", 900, 8000), ("calm", 60, 8000), ("burst", 120, 50), ("gaps", 80, 40_000)):
        for _ in range(n):
            i += 1
            rows.append((client, i, rng.randrange(span) * 1_000_000 + rng.choice([0, 0, 500_000])))
    df = spark.createDataFrame(rows, "client string, request_id bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.request_id: r.admitted for r in admission.rate_admission(df, 5, 60).collect()}
    assert got == limiter(rows, 5, 60_000_000)
    rated = {r.request_id: r.in_window for r in admission.request_rate(df, 60).collect()}
    assert rated == {i: sum(1 for c, _, t in rows if c == client and us - 60_000_000 <= t <= us) for client, i, us in rows}


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_percentiles_equal_the_builtin(spark, n):
    rng = random.Random(n)
    data = [(rng.choice([rng.random(), rng.lognormvariate(0, 4), 3.0]),) for _ in range(n)]
    df = spark.createDataFrame(data, "x double")
    got = {r.share: r.percentile for r in exact_percentiles(df, "x", [0.0, 0.5, 0.95, 0.99, 1.0]).collect()}
    for share, value in got.items():
        assert math.isclose(value, df.agg(F.percentile("x", share)).first()[0], rel_tol=1e-12)
    assert len(got) == 5
    assert exact_percentiles(df.limit(0), "x", [0.5]).count() == 0


def test_snapshot_round_trip_and_expiry(spark, shelf, tmp_path):
    root = str(tmp_path)
    books = shelf.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "deleted_at", F.lit(None).cast("timestamp"))
    links = spark.createDataFrame([(1, 1)], "canonical_book_id bigint, author_id bigint")
    tables = {"books_with_details": books, "book_authors": links}
    assert snapshots.load(spark, root, "none", FIVE) is None
    snapshots.load_or_build(tables, shelf, FIVE, root)
    key = snapshots.key_for(tables, FIVE)
    loaded = snapshots.load(spark, root, key, FIVE)
    assert loaded.catalogue.count() == 5
    later = F.current_timestamp() + F.expr("interval 25 hours")
    assert snapshots.load(spark, root, key, FIVE, later) is None
    assert snapshots.key_for(tables, ModelParams()) != key
    assert snapshots.key_for(tables | {"book_authors": links.limit(0)}, FIVE) != key
    assert snapshots.key_for(tables | {"books_with_details": books.orderBy(F.desc("id"))}, FIVE) == key
    old = snapshots.read_manifest(spark, root).first()["path"]
    snapshots.reload(tables, shelf, FIVE, root)
    assert snapshots.read_manifest(spark, root).count() == 2
    assert snapshots.inventory(spark, root).first().total_files > 0
    assert not os.path.exists(old) and snapshots.load(spark, root, key, FIVE).catalogue.count() == 5


@pytest.mark.parametrize("group, per_pass", [(100, 2), (2, 100), (3, 2)])
def test_groups_of_sources_score_in_passes(spark, five, monkeypatch, group, per_pass):
    sources = five.catalogue.select(F.col("id").alias("source_id"))
    monkeypatch.setattr(scoring, "SOURCES_PER_GROUP", group)
    monkeypatch.setattr(scoring, "SOURCES_PER_PASS", per_pass)
    got = {(r.source_id, r.id): r.score for r in scoring.scores(sources, five.vectors, "production").collect()}
    expected = {k: v for k, v in cosines(five).items() if v > 0}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 2e-6 for k, v in expected.items())


def test_most_sources_are_walked_by_the_heads_of_their_slices(spark, crowd, monkeypatch):
    monkeypatch.setattr(ranking, "FOLD_DEPTH", 24)
    monkeypatch.setattr(ranking, "LOOK_AHEAD", 1)
    rows, model = crowd
    books, folded, whole = jobs.book_keys(model.catalogue), [], ranking.fold
    monkeypatch.setattr(ranking, "fold", lambda candidates, formed, room: folded.append((candidates, formed)) or whole(candidates, formed, room))
    picked = [3, 9, 18, 27, 31, 44, 60]
    accepted = ranking.greedy(spark.createDataFrame([(i,) for i in picked], "source_id bigint"), model.vectors, books, 6).collect()
    cos, form = cosines(model), forms(rows)
    for s in picked:
        got = [r.id for r in sorted((r for r in accepted if r.source_id == s), key=lambda r: (-r.score, r.id))]
        assert got == [i for i in walk(s, cos, form, 6) if cos[s, i] > 0]
    assert "form" in folded[0][1].columns and folded[0][0].groupBy("source_id").count().agg({"count": "max"}).first()[0] == 6

"""Format spans against a brute-force version; forms of WARC records; mixing ids of any type."""

import random
import re

import numpy as np

from llm import secrets, warc
from llm.automata import Automaton, Background
from llm.mixing import mix, take


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def test_joint_scores_equal_single_ones():
    rng = random.Random(2)
    sample = ["key-" + "".join(rng.choices("ABCDEF0123456789", k=20)) for _ in range(300)] + ["x" * 900]
    tokens = ["".join(rng.choices("ABCDkeyz-_09/.", k=rng.randrange(1, 40))) for _ in range(200)] + ["", "é12", "A" * 700, *sample[:5]]
    for model in (Automaton(sample), Background(sample)):
        assert np.allclose(model.log_likelihoods(tokens), [model.log_likelihood(t) for t in tokens])


def test_every_token_is_scored_whole(spark):
    rng = random.Random(4)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    word = lambda: draw("aeiounrstlmdg", rng.randrange(3, 20))
    key = lambda k=12: draw("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k)
    texts = [" ".join(word() for _ in range(25)) + f" token={key()}" for _ in range(150)]
    short, core = key(), "sk.AB" + draw("0123456789abcdef", 16) + "XYZW"
    texts += [f"{word()} {short}", f"{word()} {core}", "first-ordinary-token " + key(), "z" * 3_000, None, "", key() + " " + key()]
    formats = secrets.learn(docs(spark, texts))
    for row in secrets.scan(docs(spark, texts), formats).collect():
        text = texts[row["doc_id"]] or ""
        base = [(s["start"], s["end"]) for s in row["spans"] if s["base"]]
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", text):
            inside = any(a <= m.start() and m.end() <= b for a, b in base)
            margin = max(a.log_likelihood(m.group()) for a in formats.automata) - formats.background.log_likelihood(m.group())
            if not inside and margin >= secrets.MARGIN:
                expected.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in row["spans"] if not s["base"]] == expected
        if short in text:
            assert len(expected) == 1  # twelve characters, as long as the shortest value learned


def test_samples_are_bounded_and_spread(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_CHARS", 400)
    texts = [f"token={i:016d}abc" for i in range(500)] + ["token=" + "9" * 5_000]
    formats = secrets.learn(docs(spark, texts), 40)
    assert 1 <= formats.automata[0].visits[0] <= 40
    plan = docs(spark, texts)
    assert secrets.scan(plan, formats).count() == len(texts)


def test_revisits_without_an_answer_and_dates_with_fractions(spark):
    def block(i, kind, date, http, more=""):
        return i, f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://e.org/\r\nWARC-Date: {date}\r\n{more}", http, f"body{i}" if http else None

    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n"
    rows = [block(1, "response", "2024-01-02T04:00:00.25Z", "HTTP/1.1 200 OK\r\nETag: \"a\"\r\n"),
            block(2, "response", "2024-01-02T04:00:00.75Z", "HTTP/1.1 200 OK\r\nETag: \"b\"\r\n"),
            block(3, "revisit", "2024-01-02T04:00:00.500001Z", None, profile), block(4, "revisit", "2024-01-02T04:00:01Z", None, "WARC-Profile: x/identical-payload-digest\r\n"),
            block(5, "revisit", "2024-01-02T04:00:02.123456789Z", "HTTP/1.1 304 Not Modified\r\nETag: \"b\"\r\n")]
    blocks = spark.createDataFrame(rows, "record_id bigint, warc_head string, http_head string, payload string")
    parsed = {r["record_id"]: r for r in warc.parse_records(blocks).collect()}
    assert [parsed[i]["kind"] for i in range(1, 6)] == ["response", "response", "revisit", None, "revisit"]
    assert parsed[1]["captured_at"] == 1_704_168_000.25
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(warc.parse_records(blocks)).collect()}
    assert got == {3: 1, 5: 2}


def test_mixing_of_named_documents_and_of_rows_that_look_alike(spark):
    rows = [(f"d{i}", "word " * (1 + i % 7), "ab"[i % 2]) for i in range(60)] + [("same", f"x{i} y z", "a") for i in range(9)]
    named = spark.createDataFrame(rows, "doc_id string, text string, source string")
    first, again = (sorted(map(tuple, mix(named.repartition(n)).collect())) for n in (2, 5))
    assert first == again and len(first) == len(rows)
    one, two = (sorted(map(tuple, take(named.repartition(n)).collect())) for n in (2, 5))
    assert one == two and take(named.limit(0)).count() == 0

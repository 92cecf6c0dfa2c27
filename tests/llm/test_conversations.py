"""Repair of conversations against a brute-force version."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from llm.conversations import REROLE, Search, damage, damaged_report, letter, repair, report

ROLE = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id bigint, turn bigint, role string, text string, copy string, times string, fault int"  # clashing names


def cheapest(rows):
    """``(cost, audit, repaired)`` of ``(role, text, must go, truncated)`` by plain search over all edits."""
    best = {"": (0, "", ())}

    def closed(states):
        for before, to in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"), ("", "u"), ("u", "a")):
            if before in states:
                cost, audit, out = states[before]
                way = (cost + 2, audit + "I", out + ((ROLE[to], ""),))
                if to not in states or way[:2] < states[to][:2]:
                    states[to] = way
        return states

    for role, text, must, cut in rows:
        after = {}
        for state, (cost, audit, out) in closed(best).items():
            ways = [(state, (cost + 3, audit + "D", out))]
            if not must:
                to = "a" if state == "u" else "u"
                ways.append((to, (cost + 2 + cut, audit + "R", out + ((ROLE[to], text),))))
                if state + role[:1] in ("u", "s", "su", "ua", "au"):
                    ways.append((role[:1], (cost + cut, audit + "K", out + ((role, text),))))
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        best = after
    return min((w for s, w in closed(best).items() if s in ("", "a")), key=lambda w: w[:2])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else v for v in (role, text)]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            said[1] = ""
        elif fault == 2:
            said[1] = re.sub("[.!?]", "", said[1])
        elif fault == 4:
            said[0] = "user"
        out += [(conv, turn, *said)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def expected_of(rows, ids):
    found = []
    for conv in set(ids):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults, marked = set(), [0, 0, 0], []
        for _, _, role, text in mine:
            bare = text.strip("\x20\t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role, text, fault in (0, 1), int(fault == 2)))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, repaired = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        found.append((conv, gaps, *faults, illegal, cost, audit, digest))
    return sorted(found, key=repr)


AWKWARD = [(1, 0, "system", "Be kind."), (1, 1, "user", None), (1, None, None, "odd"), (1, 3, "assistant", "Yes"), (1, 3, "assistant", "Yes"),
           (2, 5, "user", "x" * 200_000 + "."), (2, 6, "assistant", "Ja."), (2, 6, "assistant", "Nein."), (None, 1, "user", "Hi."),
           (None, 2, "assistant", "Ho!"), (3, None, "user", " \t"), (4, 7, "", "What?"), (4, 8, "tool", "Done."), (4, 9, "system", "Late."),
           (5, -4, "user", "Da."), (5, 9, "user", "Da."), (5, 12, "user", "Da.")]


def talk(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["A.", "B!", "C", "D. ", "e", "", "F?"]) + str(rng.randrange(3)) * (turn % 3 == 0)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("segment_rows", [3, 256])
def test_report_equals_brute_force(spark, segment_rows):
    rows = AWKWARD + [(100 + c, *r) for c, *r in talk(random.Random(4), 40, 12)] + [(9, i, "user", "Same.") for i in range(30)]
    got = sorted((tuple(r) for r in damaged_report(frame(spark, rows), segment_rows).collect()), key=repr)
    assert got == expected_of(damaged(rows), [r[0] for r in rows])


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(1, i, r, t) for i, (_, _, r, t) in enumerate(talk(random.Random(5), 60, 20))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in damaged_report(frame(spark, rows), 8).collect()]
        lines = repair(damage(frame(spark, rows)), "times", 8).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected_of(damaged(rows), [1])
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == got[0][-1]
    assert [r["place"] for r in lines] == list(range(len(lines)))


def test_search_equals_brute_force_on_all_short_conversations():
    rng = random.Random(6)
    for _ in range(3_000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 9))]
        rows = [(r, t, must, int(cut and not must)) for r, t, must, cut in rows]
        assert Search([(letter(r), m, bool(c)) for r, _, m, c in rows]).best(0) == cheapest(rows)[:2]


def test_rerole_costs_less_than_two_mends():
    assert REROLE == 2 and Search([(2, False, False)] * 3 + [(3, False, False)]).best(0) == (2, "KRKK")


def test_empty_table_and_whole_table(spark):
    assert report(frame(spark, AWKWARD).limit(0)).collect() == []
    talks = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in damaged_report(talks).collect()), key=repr)
    assert got == expected_of(damaged(rows), [r[0] for r in rows])
    assert damaged_report(talks).where(F.col("audit") == "").count() == sum(r[-2] == "" for r in got)

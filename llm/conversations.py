"""Repair of conversation structure by iterative-deepening A*.

A repaired conversation reads ``(system? (user assistant)+)?``. Edits are Delete, Insert, Keep
and Rerole; the answer is the cheapest list of edits, the ASCII-least one among equals. The
search is depth-first, tries edits in ASCII order and cuts a branch when its cost and the least
cost still needed pass a bound; the bound then rises to the least cost that was cut off. States
``(row, role before)`` that failed keep what they proved to need, so they fail at once next time.

No conversation is held whole. Rows without their texts are dealt by ranges of (conversation,
turn), so a long conversation lies over many tasks, and are searched in segments. A segment
that is a whole conversation is searched once; a part of a longer one is searched from every
state to every state. Segments are chained from the last to the first, then rows and chosen edits
stream by together. Only the last pass, which joins a conversation in its order, reads all
rows of a conversation in one task; it holds its edits, one character a row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import materialise, runs_on_workers

SEGMENT_ROWS = 256
BATCH_SEGMENTS = 1_024
ROWS = 10_000  # of a batch
BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT, OTHER, END = range(6)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
STATES = (START, SYSTEM, USER, ASSISTANT)
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts that end a conversation
DELETE, INSERT, REROLE = 3, 2, 2
INF = float("inf")
MOST = 2**63 - 1


def letter(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def due(state: int) -> int:
    """The role that an inserted or reroled row takes after a state."""
    return ASSISTANT if state == USER else USER


class Search:
    """Cheapest edits of rows ``(letter, must be deleted, truncated)`` from a state to a goal: a
    state right after the last row, or ``None`` for an end that closes the conversation."""

    def __init__(self, rows: list[tuple[int, bool, bool]], goal: int | None = None) -> None:
        self.rows, self.goal, self.n = rows, goal, len(rows)
        n = self.n
        self.first, self.base, self.run, self.rest = [END] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.leads = [False] * (n + 1)  # a system row that may stay lies ahead
        for i in range(n - 1, -1, -1):
            x, must, cut = rows[i]
            y = self.first[i + 1]
            self.leads[i] = self.leads[i + 1] or (x == SYSTEM and not must)
            if must:
                self.first[i], self.run[i], self.rest[i] = y, self.run[i + 1], self.rest[i + 1]
                self.base[i] = self.base[i + 1] + DELETE
                continue
            self.first[i], self.base[i] = x, self.base[i + 1] + cut
            if self._clash(x, y):
                self.run[i], self.rest[i] = self.run[i + 1] + 1, self.rest[i + 1]
            else:
                self.rest[i] = self.rest[i + 1] + 2 * ((self.run[i + 1] + 1) // 2)
        self.needs: dict[tuple[int, int], float] = {}

    def _clash(self, x: int, y: int) -> bool:
        if y != END:
            return (x, y) not in FOLLOWS
        return x not in (START, ASSISTANT) if self.goal is None else x != self.goal

    def _least(self, i: int, state: int) -> float:
        """Never above the true cost. Rows that must go cost 3, truncated ones at least 1. An edit
        mends two neighbouring clashes at most (rerole) and costs 2, so a run of ``k`` clashes costs
        at least ``2 * ceil(k / 2)``; deleting a truncated row costs its 1 and the 2 as well."""
        left = self.n - i
        if self.goal is not None and not left:
            return 0 if state == self.goal else INF
        if self.goal == START:
            return DELETE * left if state == START else INF
        if self.goal == SYSTEM:
            if state == SYSTEM:
                return DELETE * left
            return DELETE * (left - 1) if state == START and self.leads[i] else INF
        run = self.run[i] + self._clash(state, self.first[i])
        return self.base[i] + self.rest[i] + 2 * ((run + 1) // 2)

    def least(self, i: int, state: int) -> float:
        known = self.needs.get((i, state))
        return self._least(i, state) if known is None else known

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """``(edit, cost, next row, next state)`` in ASCII order."""
        if i < self.n:
            yield "D", DELETE, i + 1, state
        if i < self.n or self.goal is None:
            yield "I", INSERT, i, due(state)
        if i < self.n and not self.rows[i][1]:
            x, _, cut = self.rows[i]
            if (state, x) in FOLLOWS:
                yield "K", int(cut), i + 1, x
            if x != due(state):
                yield "R", REROLE + cut, i + 1, due(state)

    def done(self, i: int, state: int) -> bool:
        return i == self.n and (state in (START, ASSISTANT) if self.goal is None else state == self.goal)

    def best(self, start: int) -> tuple[int, str] | None:
        """``(cost, edits)``, or nothing where the goal cannot be reached."""
        bound = self.least(0, start)
        while bound < INF:
            found = self._within(bound, start)
            if found is not None:
                return int(bound), found
            bound = self.least(0, start)
        return None

    def _within(self, bound: float, start: int) -> str | None:
        path: list[str] = []
        frames = [[0, start, 0, self.edits(0, start), INF]]
        while frames:
            i, state, spent, edits, _ = frame = frames[-1]
            if self.done(i, state):
                return "".join(path)
            for edit, cost, then, after in edits:
                need = cost + self.least(then, after)
                if spent + need <= bound:
                    frames.append([then, after, spent + cost, self.edits(then, after), INF])
                    path.append(edit)
                    break
                frame[4] = min(frame[4], need)
            else:
                self.needs[i, state] = need = max(frame[4], self.least(i, state))
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], spent - frames[-1][2] + need)
        return None


SEGMENT_COLUMNS = "copy bigint, blank bigint, duplicate bigint, truncated bigint, costs array<bigint>, audits array<string>"


def _segments(segment_rows: int):
    """Segments of sorted narrow rows, searched. A conversation that begins after the first row
    of a task and ends before its last one lies in the task whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        schema = None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out))
            made = [pa.array(c, schema.field(n).type) for c, n in zip(columns[:4], names)]
            made += [pa.array(c, pa.int64()) for c in columns[4:8]]
            made += [pa.array(columns[8], pa.list_(pa.int64())), pa.array(columns[9], pa.list_(pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=[*names, "copy", "blank", "duplicate", "truncated", "costs", "audits"])

        def close(whole: bool) -> None:
            faults = [sum(f == k for _, f in rows) for k in (1, 2, 3)]
            searched = [(x, f in (1, 2), f == 3) for x, f in rows]
            if whole:
                cost, audit = Search(searched).best(START)
                out.append((*key, *faults, [cost], [audit]))
            else:
                goals = [Search(searched, goal) for goal in STATES]
                found = [goal.best(start) or (None, None) for start in STATES for goal in goals]
                out.append((*key, *faults, [c for c, _ in found], [a for _, a in found]))

        rows: list[tuple[int, int]] = []
        key: tuple = ()
        current, begun, inside, parted = object(), False, False, False
        for batch in batches:
            names, schema = batch.schema.names[:4], batch.schema
            for conv, turn, role, digest, copies, first, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != current:
                    if rows:
                        close(whole=inside and not parted)
                        rows = []
                    inside, parted, current, begun = begun, False, conv, True
                for copy in range(copies):
                    if len(rows) == segment_rows:
                        close(whole=False)
                        rows, parted = [], True
                    if not rows:
                        key = (conv, turn, role, digest, copy)
                    rows.append((letter(role), 1 if blank else 2 if copy or not first else 3 if cut else 0))
                    if len(out) >= BATCH_SEGMENTS:
                        yield emit()
        if rows:
            close(whole=False)
        if out:
            yield emit()

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, last one first: the state to leave each for, by the state before it."""
    current, begun, after = None, False, {}
    for batch in batches:
        exits = []
        at = {n: batch.column(n) for n in ("conv_id", "costs", "audits")}
        for conv, costs, audits in zip(*(at[n].to_pylist() for n in at)):
            if not begun or conv != current:
                current, begun, after = conv, True, {s: INSERT * CLOSING[s] for s in STATES}
            leave, before = [], {}
            for start in STATES:
                ways = [(costs[4 * start + to] + after[to], audits[4 * start + to], to)
                        for to in STATES if costs[4 * start + to] is not None and after[to] < INF]
                before[start], _, to = min(ways) if ways else (INF, "", -1)
                leave.append(to)
            exits.append(leave)
            after = before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(exits, pa.list_(pa.int32()))],
                                         names=[*batch.schema.names, "exits"])


class Conversation:
    """A conversation streaming by: edits arrive ahead of the rows that they are for."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.state, self.chain, self.pending, self.at, self.audit = conv_id, START, START, deque(), 0, []
        self.blank = self.duplicate = self.truncated = self.cost = self.illegal = self.distinct = 0
        self.last_role = self.least_turn = self.last_turn = None
        self.whole = True

    def edit(self, segment: tuple) -> None:
        blank, duplicate, truncated, costs, audits, exits = segment
        place = 0
        if exits is not None:
            place, self.whole = 4 * self.chain + exits[self.chain], False
            self.chain = exits[self.chain]
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.cost += costs[place]
        self.pending.append(audits[place])
        self.audit.append(audits[place])

    def _next(self) -> str | None:
        while self.pending and self.at == len(self.pending[0]):
            self.pending.popleft()
            self.at = 0
        if not self.pending:
            return None
        self.at += 1
        return self.pending[0][self.at - 1]

    def inserted(self) -> tuple[str, str]:
        self.state = due(self.state)
        return ROLES[self.state], ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows up to and with this one."""
        if self.last_role is not None and self.last_role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role[:1]
        if turn is not None:
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.distinct += turn != self.last_turn
            self.last_turn = turn
        while (edit := self._next()) == "I":
            yield self.inserted()
        if edit == "K":
            self.state = letter(role)
            yield role, text
        elif edit == "R":
            self.state = due(self.state)
            yield ROLES[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        """Rows inserted after the last one."""
        if not self.whole:
            closing = "I" * CLOSING[self.state]
            self.cost += INSERT * len(closing)
            self.pending.append(closing)
            self.audit.append(closing)
        while self._next() == "I":
            yield self.inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.last_turn is None else min(self.last_turn - self.least_turn + 1 - self.distinct, MOST)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, tuple[str, str] | None]]:
    """Repaired rows in order; ``None`` once after the last of each conversation."""
    now = None
    for batch in batches:
        for conv, turn, role, text, times, *segment in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv:
                if now is not None:
                    yield from ((now, row) for row in now.rest())
                    yield now, None
                now = Conversation(conv)
            if segment[0] is not None:
                now.edit(tuple(segment))
            for _ in range(times):
                yield from ((now, row) for row in now.row(turn, role, text))
    if now is not None:
        yield from ((now, row) for row in now.rest())
        yield now, None


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the ids, and the batches."""
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.schema.field(0).type, chain([first], batches))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    id_type, batches = _typed(batches)
    done, digest, begun = [], hashlib.sha256(), False

    def made() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]],
             *[pa.array(c, pa.string()) for c in columns[7:]]],
            names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    for c, row in _walk(batches):
        if row is not None:
            digest.update(("\n" if begun else "").encode() + f"{row[0]}:{row[1]}".encode())
            begun = True
            continue
        done.append((c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, "".join(c.audit), digest.hexdigest()))
        digest, begun = hashlib.sha256(), False
        if len(done) >= ROWS:
            yield made()
    if done:
        yield made()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    id_type, batches = _typed(batches)
    lines, size, place, last = [], 0, 0, None

    def made() -> pa.RecordBatch:
        ids, places, roles, texts = zip(*lines)
        lines.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(places, pa.int64()), pa.array(roles), pa.array(texts)],
                                          names=["conv_id", "place", "role", "text"])

    for conversation, row in _walk(batches):
        if row is None:
            continue
        place = place + 1 if conversation is last else 0
        last = conversation
        lines.append((conversation.conv_id, place, *row))
        size += len(row[1])
        if len(lines) >= ROWS or size >= 1 << 22:
            yield made()
            size = 0
    if lines:
        yield made()


def _planned(rows: DataFrame, ids: DataFrame, times: str | None, segment_rows: int) -> DataFrame:
    """Segments with their edits and the rows, in the order of each conversation."""
    typed = rows.select("conv_id", F.col("turn").try_cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.col(times).cast("int") if times else F.lit(1)).alias("times"))
    typed = typed.where(F.col("times") > 0).withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    key = ["conv_id", "turn", "role", "digest"]
    bare = F.btrim("text", F.lit(BLANKS))
    narrow = typed.groupBy(*key).agg(
        F.sum("times").alias("copies"), F.first(bare == "").alias("blank"),
        F.first(~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("at")).select(
        F.col("conv_id").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"))
    marked = narrow.join(  # by the whole key, which is unique on both sides: no key is crowded
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").select(
        *key, "copies", F.col("r").isNotNull().alias("first"), "blank", "cut")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, turn bigint, role string, digest string, {SEGMENT_COLUMNS}"
    found = materialise(marked.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_segments(segment_rows), schema),
                        "segments")
    parts = found.where(F.size("costs") > 1).repartition("conv_id").sortWithinPartitions(
        "conv_id", *[F.desc(c) for c in ("turn", "role", "digest", "copy")])
    edits = found.where(F.size("costs") == 1).withColumn("exits", F.lit(None).cast("array<int>")).unionByName(
        parts.mapInArrow(_chained, f"{schema}, exits array<int>"))
    segment = [F.col(c) for c in ("blank", "duplicate", "truncated", "costs", "audits", "exits")]
    none = [F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in ("blank", "duplicate", "truncated", "costs", "audits", "exits")]
    no_text, no_time = F.lit(None).cast("string"), F.lit(0)
    lines = edits.select(*key, F.lit(1).alias("kind"), "copy", no_text.alias("text"), no_time.alias("times"), *segment)
    lines = lines.unionByName(typed.select(*key, F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("copy"), "text", "times", *none))
    lines = lines.unionByName(ids.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), no_text.alias("role"), no_text.alias("digest"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("copy"), no_text.alias("text"), no_time.alias("times"), *none))
    return lines.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("kind") > 0, "turn", "role", "digest", "kind", "copy").select(
        "conv_id", "turn", "role", "text", "times", *segment)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of ``conv_id:turn``, modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its ``.!?``, 3 repeats it (``times`` is 2), 4 makes it the user's. Null values count
    as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(word("conv_id"), F.lit(":"), word("turn")), "UTF-8")) % 20
    return conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault")).where(
        "fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))


def repair(rows: DataFrame, times: str | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, role, text)``, places from 0.

    Rows without text and repeated rows are faults, so they go. See ``report`` for the order, ties
    and edge cases."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return _planned(rows, rows, times, segment_rows).mapInArrow(
        _repaired, f"conv_id {id_type}, place bigint, role string, text string")


def report(rows: DataFrame, ids: DataFrame | None = None, times: str | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per ``conv_id`` of ``ids`` or ``rows``: faults, cost, edits and the digest of the
    repaired conversation.

    Rows are ``(conv_id, turn, role, text)``; the column ``times`` names, if any, says how often a
    row stands there. Null role and text count as one space; a null turn, or one that is no number,
    comes first; a null conv_id is a conversation of its own. Rows of one turn stand by role, then by
    the SHA-256 of the text, so the result does not depend on the layout of the table. Repeated rows
    are duplicates. A conversation without rows gets zeros, no edits and the digest of nothing. An
    empty table gives no rows. Texts may have any length. Other columns are ignored. Gaps above 64
    bits stop at the limit.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    known = rows.select("conv_id") if ids is None else ids.select("conv_id").unionByName(rows.select("conv_id"))
    return _planned(rows, known, times, segment_rows).mapInArrow(
        _reports, f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string")


def damaged_report(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The report on ``conversations`` after ``damage``, with every conversation of the table."""
    return report(damage(conversations), conversations, "times", segment_rows)


runs_on_workers(__name__)

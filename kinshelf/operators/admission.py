"""Request rates per client and the sliding-window rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinshelf.params import RATE_LIMIT_PER_MINUTE, RATE_WINDOW_SECONDS
from kinshelf.session import materialise, runs_on_workers, small

MICROS = 1_000_000
WINDOWS_PER_SLICE = 60
WINDOWS_PER_WALK = 16


def _timed(requests: DataFrame) -> DataFrame:
    """``us``: the event time in microseconds, for numeric range frames."""
    return requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _slice_of(at: str, window: int) -> Column:
    return F.floor(F.col(at) / (window * WINDOWS_PER_SLICE))


def _trailing(rows: DataFrame, at: str, window: int, **aggregates: Column) -> DataFrame:
    """Adds aggregates over each client's closed trailing frame ``[at - window, at]``.

    The timeline of a client is cut into slices. Rows near the end of a slice are repeated
    as context for the next one, so a client with very many rows is spread over tasks and
    the frames stay whole.
    """
    number = _slice_of(at, window)
    near_end = (number + 1) * (window * WINDOWS_PER_SLICE) - F.col(at) <= window
    own = F.struct(number.alias("slice"), F.lit(False).alias("context"))
    following = F.struct((number + 1).alias("slice"), F.lit(True).alias("context"))
    places = F.when(near_end, F.array(own, following)).otherwise(F.array(own))
    spread = rows.select("*", F.explode(places).alias("place"))
    frame = Window.partitionBy("client", "place.slice").orderBy(at).rangeBetween(-window, 0)
    counted = spread.select("*", *[a.over(frame).alias(name) for name, a in aggregates.items()])
    return counted.where(~F.col("place.context")).drop("place")


def request_rate(requests: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Adds ``in_window``: the client's requests in the closed trailing window."""
    rated = _trailing(_timed(requests), "us", window_seconds * MICROS, in_window=F.count(F.lit(1)))
    return rated.drop("us")


def _chains(crowded: DataFrame, window: int) -> DataFrame:
    """Adds ``chain``: the start time of the run of crowded rows a row belongs to.

    A run starts where no earlier crowded row lies within the window. The start is carried
    from slice to slice through a table of one row per client and slice.
    """
    marked = _trailing(crowded, "us", window, earliest=F.min("us")).select(
        "*", _slice_of("us", window).alias("slice"),
        F.when(F.col("earliest") == F.col("us"), F.col("us")).alias("start")).drop("earliest")
    before = Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("client", "slice").agg(F.max("start").alias("last_start")).select(
        "client", "slice", F.max("last_start").over(before).alias("carried"))
    so_far = Window.partitionBy("client", "slice").orderBy("us").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = marked.select("*", F.max("start").over(so_far).alias("inside"))
    return inside.join(carried, ["client", "slice"]).select(
        "client", "us", "request_id", F.coalesce("inside", "carried").alias("chain"))


SLICE = ["client", "chain", "slice"]
WALKED = "client {client}, chain bigint, slice bigint, request_id {request}, admitted boolean, state array<bigint>"


def _walk(limit: int, window: int, slice_length: int):
    """Streaming limiter over rows sorted by (client, chain, slice, kind, us, request_id).

    A slice begins with a row of kind 0 that brings the times of the admitted requests before it, and
    its last row out carries those that still count at its end. Between batches there are at most
    ``limit`` times. While the window is full the walk jumps to the first row after the oldest has left.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()

        def ending() -> pd.DataFrame:
            client, chain, number = current
            kept = [int(t) for t in admitted if t >= (number + 1) * slice_length - window]
            return pd.DataFrame({"client": [client], "chain": [chain], "slice": [number], "request_id": [None], "admitted": [None], "state": [kept]})

        for batch in batches:
            heads = np.flatnonzero(batch["kind"].to_numpy() == 0)
            us, accepted = batch["us"].to_numpy(), np.zeros(len(batch), dtype=bool)
            for begin, end in pairwise([0, *heads[heads > 0], len(batch)]):
                if end > begin and batch["kind"].iat[begin] == 0:
                    if current is not None:
                        yield ending()
                    row = batch.iloc[begin]
                    current, admitted = (row["client"], int(row["chain"]), int(row["slice"])), deque(row["state"])
                    begin += 1
                i = begin
                while i < end:
                    while admitted and admitted[0] < us[i] - window:
                        admitted.popleft()
                    if len(admitted) < limit:
                        accepted[i] = True
                        admitted.append(us[i])
                        i += 1
                    else:
                        i = max(i + 1, begin + int(np.searchsorted(us[begin:end], admitted[0] + window, "right")))
            rows = batch["kind"].to_numpy() == 1
            if rows.any():
                out = batch.loc[rows, [*SLICE, "request_id"]]
                yield out.assign(admitted=accepted[rows], state=None)
        if current is not None:
            yield ending()

    return run


def _decided(busy: DataFrame, limit: int, window: int) -> DataFrame:
    """``(request_id, admitted)`` of the runs ``(client, chain, request_id, us)``.

    A run is cut into time slices that are walked at the same time. The first time each starts from
    nothing, which is true of the first slice only; then every slice whose start is not what the slice
    before it ended with is walked again from there. Walks from different starts soon meet, so
    few slices go again and the rounds are few; where they never meet, the rounds walk the run in
    order. The result is that of one walk either way.
    """
    length = window * WINDOWS_PER_WALK
    busy = materialise(busy.withColumn("slice", F.floor(F.col("us") / length)), "busy")
    before = F.lag("slice").over(Window.partitionBy("client", "chain").orderBy("slice"))
    slices = materialise(busy.select(*SLICE).distinct().select(*SLICE, before.alias("previous")), "slices")
    schema = WALKED.format(client=busy.schema["client"].dataType.simpleString(), request=busy.schema["request_id"].dataType.simpleString())
    none = F.array().cast("array<bigint>")
    todo, starts, walks, turn = slices.select(*SLICE, none.alias("state")), None, None, 0
    while True:
        begun = todo.select(*SLICE, "state", F.lit(turn).alias("turn"))
        starts = begun if starts is None else materialise(starts.unionByName(begun), "starts")
        heads = todo.select(*SLICE, F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("us"),
                            F.lit(None).cast(busy.schema["request_id"].dataType).alias("request_id"), "state")
        rows = busy.join(small(todo.select(*SLICE)), SLICE, "left_semi").select(
            *SLICE, F.lit(1).alias("kind"), "us", "request_id", F.lit(None).cast("array<bigint>").alias("state"))
        walk = heads.unionByName(rows).repartition(*SLICE).sortWithinPartitions(*SLICE, "kind", "us", "request_id").mapInPandas(
            _walk(limit, window, length), schema)
        walk = materialise(walk.withColumn("turn", F.lit(turn)), "walk")
        walks = walk if walks is None else walks.unionByName(walk)
        ends = walks.where(F.col("state").isNotNull()).groupBy(*SLICE).agg(F.max_by("state", "turn").alias("ended"))
        held = starts.groupBy(*SLICE).agg(F.max_by("state", "turn").alias("started"))
        expected = slices.where(F.col("previous").isNotNull()).join(
            ends.withColumnRenamed("slice", "previous"), ["client", "chain", "previous"]).select(*SLICE, F.col("ended").alias("state"))
        todo = materialise(expected.join(held, SLICE).where(F.col("state") != F.col("started")).select(*SLICE, "state"), "todo")
        turn += 1
        if todo.isEmpty():
            break
    last = starts.groupBy(*SLICE).agg(F.max("turn").alias("turn"))
    return walks.where(F.col("state").isNull()).join(last, [*SLICE, "turn"]).select("request_id", "admitted")


def rate_admission(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                   window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """``(client, request_id, admitted)``: admitted iff fewer than ``limit`` admitted requests lie in
    the closed window before it; rejected ones do not count.

    A request with at most ``limit`` requests in its window, itself included, is admitted
    whatever was decided before. Only runs of crowded requests, with the free ones their
    windows reach back to, are walked, each run in slices of its own. Rows stream through the
    tasks; they are never held as a group.
    """
    window = window_seconds * MICROS
    rated = _trailing(_timed(requests.select("client", "request_id", "ts")), "us", window,
                      in_window=F.count(F.lit(1)))
    rows = rated.select("client", "request_id", "us", (F.col("in_window") <= limit).alias("free"))
    chained = _chains(rows.where(~F.col("free")), window)
    # A free row joins the run of the crowded rows that follow within the window, if any:
    # seen backwards in time those are a trailing frame.
    both = rows.join(chained.select("request_id", "chain"), "request_id", "left").withColumn("back", -F.col("us"))
    # Written once: both branches below read it.
    walked = materialise(_trailing(both, "back", window, next_chain=F.max("chain")).select(
        "client", "request_id", "us", "free", F.coalesce("chain", "next_chain").alias("chain")), "walked")
    calm = walked.where(F.col("chain").isNull()).select("request_id", F.lit(True).alias("admitted"))
    busy = walked.where(F.col("chain").isNotNull()).select("client", "chain", "request_id", "us")
    return calm.unionByName(_decided(busy, limit, window))


runs_on_workers(__name__)

"""Searches over vectors dealt by space: regions, bounds, two rounds with a shared bar.

Both searches of this package use it. Rows of one vector are one point with its smallest ids, and
rows that ask with one vector ask once, so a vector that a third of all rows have costs no more
than any other. A tree of planes, learned from a bounded sample, deals points to regions; crowded
regions are split by hash. A question first searches the piece where its own vector lies.
The kth score found there is its bar, and it is sent only to the regions whose bound
``q.c + |q| r`` (centre, radius) reaches the bar. A task holds one piece of a region and one group of
questions, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.common import materialise, runs_on_workers

SHARD_ROWS = 8_192
QUERY_ROWS = 4_096
REGIONS = 1_024
SAMPLE_ROWS = 16_384
VALUES = 1 << 22  # of a sample, a shard or a group of questions: fewer rows where vectors are long
BLOCK_VALUES = 1 << 20

# (points, least id of each, questions, bars, k) -> (question, rows, scores), best first, ties to the smaller id
Finder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple[int, np.ndarray, np.ndarray]]]


class Planes:
    """A balanced tree of planes between far points; leaves are regions with a centre."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.normal, self.level, self.child, self.centres = [], [], [], []
        self._grow(sample, leaves)
        self.centres = np.array(self.centres)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        """The node of these rows; leaves are numbered from -1 downwards."""
        centre = rows.mean(axis=0)
        if leaves > 1 and len(rows) > 1:
            one = rows[((rows - centre) ** 2).sum(1).argmax()]
            other = rows[((rows - one) ** 2).sum(1).argmax()]
            along = rows @ (other - one)
            level = float(np.median(along))
            right = along > level
            if right.any() and not right.all():
                node = len(self.normal)
                self.normal.append(other - one)
                self.level.append(level)
                self.child.append([0, 0])
                self.child[node][0] = self._grow(rows[~right], leaves - leaves // 2)
                self.child[node][1] = self._grow(rows[right], leaves // 2)
                return node
        self.centres.append(centre)
        return -len(self.centres)

    def regions(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), np.int32)
        stack = [(0 if self.normal else -1, np.arange(len(rows)))]
        while stack:
            node, mine = stack.pop()
            if node < 0:
                found[mine] = -node - 1
            elif len(mine):
                right = rows[mine] @ self.normal[node] > self.level[node]
                stack += [(self.child[node][0], mine[~right]), (self.child[node][1], mine[right])]
        return found


def by_length(batch: pa.RecordBatch | pa.Table, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, vectors)`` in steps of bounded size."""
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = values.value_lengths().to_numpy()
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step = max(1, BLOCK_VALUES // max(int(size), 1))
        for at in range(0, len(every), step):
            rows = every[at:at + step]
            flat = values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield int(size), rows, flat.reshape(len(rows), size)


def _placer(planes: dict[int, Planes]):
    """The region of each row and its distance to the centre; lengths without planes are one region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for size, rows, x in by_length(batch, "x"):
                if size in planes:
                    wide = x.astype(float)
                    region[rows] = found = planes[size].regions(wide)
                    away[rows] = np.sqrt(((wide - planes[size].centres[found]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(away)],
                                             names=[*batch.schema.names, "region", "away"])

    return run


def _router(planes: dict[int, Planes], radii: dict[int, np.ndarray]):
    """The regions whose bound reaches the bar of a question."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars, reached = batch.column("bar").to_numpy(), [[0]] * batch.num_rows
            for size, rows, x in by_length(batch, "x"):
                if size not in planes:
                    continue
                q, centres = x.astype(float), planes[size].centres
                norms = np.sqrt((q**2).sum(1))[:, None]
                bound = q @ centres.T + norms * radii[size][None, :]
                bound += 1e-9 * (np.abs(bound) + norms * (radii[size] + np.sqrt((centres**2).sum(1))) + 1e-300)
                hit = (bound >= bars[rows][:, None]) | ~np.isfinite(bound)
                for r, row in enumerate(rows):
                    reached[row] = np.flatnonzero(hit[r] & (radii[size] >= 0)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "regions"])

    return run


def _searcher(find: Finder, k: int, score_type: pa.DataType):
    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        keys, ids, copies, scores = [], [], [], []
        if points.num_rows and asked.num_rows:
            (_, _, x), *_ = whole = list(by_length(points, "x"))
            x = x if len(whole) == 1 else np.concatenate([w[2] for w in whole])
            q = np.concatenate([w[2] for w in by_length(asked, "x")])
            held, key = points["ids"].to_pylist(), asked["key"].to_pylist()
            least = np.array([h[0]["vec_id"] for h in held])
            for at, rows, found in find(x, least, q, asked["bar"].to_numpy(), k):
                named = sorted((-s, i["vec_id"], i["copies"]) for r, s in zip(rows.tolist(), found.tolist()) for i in held[r])[:k]
                for s, i, n in named:
                    keys.append(key[at])
                    ids.append(i)
                    copies.append(n)
                    scores.append(-s)
        return pa.table({"key": pa.array(keys, pa.string()), "vec_id": pa.array(ids, pa.int64()),
                         "copies": pa.array(copies, pa.int64()), "score": pa.array(scores, score_type)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "copies")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(7)), pieces).cast("int")


def dealt(spark, counts: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """The table ``(dim, region, pieces, parts)``, at most ``REGIONS`` rows for each length."""
    return spark.createDataFrame([(d, r, p, n) for (d, r), (p, n) in counts.items()], "dim int, region int, pieces int, parts int")


class Space:
    """Points and questions over ``(vec_id, x, asks)``, with regions; see ``nearest``."""

    def __init__(self, ready: DataFrame, k: int, shard_rows: int, query_rows: int, regions: int) -> None:
        self.spark, self.query_rows = ready.sparkSession, query_rows
        key = F.concat_ws(":", F.xxhash64("x").cast("string"), F.xxhash64("x", F.lit(1)).cast("string"), F.size("x").cast("string"))
        rows = ready.withColumn("key", key).groupBy("vec_id", "key").agg(
            F.first("x").alias("x"), F.first("asks").alias("asks"), F.count("*").alias("copies"))
        self.rows = rows = materialise(rows.withColumn("dim", F.size("x")), "vectors")
        own = rows.where("asks").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
        self.k = k + own  # a question never finds its own rows
        longest = rows.agg(F.max("dim")).first()[0] or 1
        bound = max(1, VALUES // max(longest, 1))
        sample = rows.select("x", "key").orderBy(F.xxhash64("key", F.lit(3)), "vec_id").limit(min(SAMPLE_ROWS, bound)).toArrow()
        sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        shard_rows, self.query_rows = max(1, min(shard_rows, bound)), max(1, min(query_rows, bound))
        self.planes: dict[int, Planes] = {}
        held: dict[int, list[np.ndarray]] = {}
        for size, _, x in by_length(sample, "x"):
            held.setdefault(size, []).append(x.astype(float))
        for size, blocks in held.items():
            if size:
                self.planes[size] = Planes(np.unique(np.concatenate(blocks), axis=0), min(regions, -(-sizes[size] // shard_rows)))
        first_ids = Window.partitionBy("key").orderBy("vec_id")
        points = rows.withColumn("at", F.row_number().over(first_ids)).where(F.col("at") <= self.k).groupBy("key").agg(
            F.first("dim").alias("dim"), F.first("x").alias("x"),
            F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))  # at most k
        item = rows.schema["x"].dataType.simpleString()
        self.columns = f"key string, dim int, x {item}"
        schema = f"{self.columns}, ids array<struct<vec_id:bigint,copies:bigint>>, region int, away double"
        self.points = materialise(points.select("key", "dim", "x", "ids").mapInArrow(_placer(self.planes), schema), "points")
        asked = rows.where("asks").groupBy("key").agg(F.first("dim").alias("dim"), F.first("x").alias("x"))
        self.asked = materialise(asked.mapInArrow(_placer(self.planes), f"{self.columns}, region int, away double").drop("away"), "asked")
        found = self.points.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
        self.pieces = {(r["dim"], r["region"]): -(-r["n"] // shard_rows) for r in found}
        self.radii = {size: np.full(len(p.centres), -1.0) for size, p in self.planes.items()}
        for r in found:
            if r["dim"] in self.radii:
                self.radii[r["dim"]][r["region"]] = r["radius"]

    def search(self, asked: DataFrame, find: Finder, score_type: str) -> DataFrame:
        """``(key, vec_id, copies, score)`` of ``(key, dim, x, bar, region, piece)``."""
        place = ["dim", "region"]
        crowd = {(r["dim"], r["region"]): r["n"] for r in asked.groupBy(*place, "piece").count().groupBy(*place).agg(
            F.max("count").alias("n")).collect()}
        table = dealt(self.spark, {at: (pieces, -(-crowd[at] // self.query_rows)) for at, pieces in self.pieces.items() if at in crowd})
        rows = self.points.join(F.broadcast(table), place).select(
            *place, "x", "ids", _piece(F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        questions = asked.join(F.broadcast(table.select(*place, "parts")), place).select(
            *place, "piece", F.pmod(F.xxhash64("key", F.lit(11)), F.col("parts")).cast("int").alias("part"), "key", "x", "bar")
        group = [*place, "piece", "part"]
        arrow = pa.int64() if score_type == "bigint" else pa.float64()
        return rows.groupBy(*group).cogroup(questions.groupBy(*group)).applyInArrow(
            _searcher(find, self.k, arrow), f"key string, vec_id bigint, copies bigint, score {score_type}")

    def routed(self, asked: DataFrame) -> DataFrame:
        """Questions ``(key, dim, x, region, piece, bar)`` with every other piece that may reach the bar."""
        sent = asked.mapInArrow(_router(self.planes, self.radii), f"{self.columns}, region int, piece int, bar double, regions array<int>")
        sent = sent.select("key", "dim", "x", "bar", F.col("region").alias("home"), F.col("piece").alias("first"), F.explode("regions").alias("region"))
        table = dealt(self.spark, {at: (pieces, 0) for at, pieces in self.pieces.items()})
        sent = sent.join(F.broadcast(table), ["dim", "region"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        return sent.where(~((F.col("home") == F.col("region")) & (F.col("first") == F.col("piece")))).select(
            "key", "dim", "x", "bar", "region", "piece")

    def homes(self) -> DataFrame:
        """Questions at the piece where their own vector lies."""
        table = dealt(self.spark, {at: (pieces, 0) for at, pieces in self.pieces.items()})
        return self.asked.join(F.broadcast(table), ["dim", "region"]).select(
            "key", "dim", "x", "region", _piece(F.col("pieces")).alias("piece"))

    def barred(self, found: DataFrame) -> DataFrame:
        """Questions at home with the kth score found there as their bar."""
        bars = found.groupBy(F.col("key").alias("of")).agg(F.min("score").cast("double").alias("least"), F.count("*").alias("got"))
        return self.homes().join(bars, F.col("key") == F.col("of"), "left").select(
            "key", "dim", "x", "region", "piece",
            F.when(F.col("got") == self.k, F.col("least")).otherwise(float("-inf")).alias("bar"))


def nearest(ready: DataFrame, k: int, find: Finder, score_type: str, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
            regions: int = REGIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row that asks.

    ``ready`` is ``(vec_id bigint, x array, asks boolean)`` without nulls. ``find`` gives the best points
    of a shard by score, leaving out only points below the bar. A row repeated with its id counts
    as often as it stands there, never for its own id, and asks once; an id with several vectors asks
    with each, and its best rows over all of them count."""
    space = Space(ready, k, shard_rows, query_rows, regions)
    first = materialise(_best(space.search(
        space.homes().withColumn("bar", F.lit(float("-inf"))), find, score_type), space.k), "first_round")
    rest = space.search(materialise(space.routed(space.barred(first)), "questions"), find, score_type)
    best = materialise(_best(first.unionByName(rest), space.k), "best")
    asks = space.rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("of"))
    found = asks.join(best, F.col("of") == F.col("key")).where(F.col("vec_id") != F.col("query_id"))
    found = found.groupBy("query_id", "vec_id", "score").agg(F.max("copies").alias("copies"))
    every = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("_"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite components."""
    wide = vector.cast("array<double>")
    return wide.isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


runs_on_workers(__name__)

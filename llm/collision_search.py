"""Approximate nearest neighbours by counting collisions of query-aware hashes.

Largest inner product becomes least distance: a vector ``x`` gets one more component
``sqrt(M^2 - |x|^2)``, with ``M`` the largest norm, and a question is scaled to norm ``M``. A shard
holds one sorted array per random projection. A question opens a window around its own projection in
each array, half as wide as ``HALF_WIDTH`` times a radius; virtual rehashing widens the radius by
``RATIO`` and counts only the rows that a window adds. Rows in at least ``threshold`` windows are
verified by their exact inner product. The search ends when the radius has reached the distance of
the kth best: a row nearer than that collides in each array with a probability of at least ``p``, so it
misses the threshold with a probability of at most about ``MISS``. Distances only grow thinner with
more shards, since the bar of a question is shared between them (``llm.space``).

Projections are drawn, not learned; the planes that deal rows to regions are learned from a bounded
sample. Every row is in the index, and no bucket has a cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import runs_on_workers
from llm.space import QUERY_ROWS, REGIONS, SHARD_ROWS, finite, nearest

PROJECTIONS = 48
HALF_WIDTH = 1.4
RATIO = 1.5
LEVELS = 10  # radii below twice the largest norm
MISS = 0.05


def threshold(projections: int, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """Collisions that a row at the radius itself reaches but for ``miss`` of the cases."""
    p = 2 * NormalDist().cdf(half_width) - 1
    spread = math.sqrt(projections * p * (1 - p))
    return max(1, math.floor(projections * p + NormalDist().inv_cdf(miss) * spread))


class SortedProjections:
    """One sorted array of the rows per projection, laid end to end for joint lookups."""

    def __init__(self, rows: np.ndarray, most: float, projections: int, seed: int) -> None:
        self.rows, self.n = rows, len(rows)
        size = rows.shape[1]
        axes = np.random.default_rng(seed).normal(size=(projections, size + 1))
        self.axes, self.most = axes[:, :size], most
        last = np.sqrt(np.maximum(most**2 - (rows**2).sum(1), 0.0))
        along = rows @ self.axes.T + last[:, None] * axes[:, size]
        order = np.argsort(along, axis=0, kind="stable")
        value = np.take_along_axis(along, order, 0)
        self.order = np.ascontiguousarray(order.T).ravel()
        self.low, high = value.min() - 1.0, value.max() + 1.0
        self.width = high - self.low
        self.starts = np.arange(projections) * self.width
        self.flat = (np.ascontiguousarray(value.T) - self.low + self.starts[:, None]).ravel()

    def at(self, points: np.ndarray, side: str) -> np.ndarray:
        """Places of one value per projection."""
        inside = np.clip(points - self.low, 0.0, self.width * (1 - 1e-12))
        return np.searchsorted(self.flat, inside + self.starts, side)

    def added(self, low: np.ndarray, high: np.ndarray, new_low: np.ndarray, new_high: np.ndarray) -> np.ndarray:
        """How often each row is in what the windows gained."""
        gained = [self.order[a:b] for a, b in zip(new_low.tolist(), low.tolist()) if a < b]
        gained += [self.order[a:b] for a, b in zip(high.tolist(), new_high.tolist()) if a < b]
        return np.bincount(np.concatenate(gained), minlength=self.n) if gained else np.zeros(self.n, np.int64)


def search(index: SortedProjections, vectors: np.ndarray, least: np.ndarray, q: np.ndarray, bar: float, k: int, scale: float,
           needed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, scores)`` of at most ``k`` rows for one question, best first. ``index`` holds the
    vectors divided by ``scale``."""
    most, small = index.most, q / scale
    norm = math.sqrt(float((small**2).sum()))
    if norm == 0.0:  # below what doubles tell from zero: every row is as good
        scores = (vectors * q).sum(1)
        best = np.lexsort((least, -scores))[:k]
        return best, scores[best]
    centre = index.axes @ (small * (most / norm))

    def distance(score: float) -> float:
        return math.sqrt(max(2 * most**2 - 2 * most * (score / scale / scale) / norm, 0.0)) if score > -math.inf else math.inf

    low = high = index.at(centre, "left")
    counts, seen = np.zeros(index.n, np.int64), np.zeros(index.n, bool)
    rows, scores = np.empty(0, np.int64), np.empty(0)
    level = LEVELS
    while level > 0 and 2 * most * RATIO**-(level - 1) < distance(bar) < math.inf:
        level -= 1  # a bar from elsewhere: begin one level below it
    while True:
        radius = min(2 * most * RATIO**-level, distance(bar))
        half = HALF_WIDTH * radius
        new_low, new_high = np.minimum(index.at(centre - half, "left"), low), np.maximum(index.at(centre + half, "right"), high)
        counts += index.added(low, high, new_low, new_high)
        low, high = new_low, new_high
        ending = level == 0
        fresh = np.flatnonzero(~seen if ending and len(rows) < k and bar == -math.inf else (counts >= needed) & ~seen)
        if len(fresh):
            seen[fresh] = True
            exact = (vectors[fresh] * q).sum(1)
            fresh, exact = fresh[exact >= bar], exact[exact >= bar]
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, exact])
            best = np.lexsort((least[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                bar = max(bar, float(scores[-1]))
        if ending or radius >= distance(bar):
            return rows, scores
        level -= 1


def _finder(most: dict[int, float], scale: dict[int, float], projections: int):
    def find(x: np.ndarray, least: np.ndarray, questions: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        size, wide = x.shape[1], np.ascontiguousarray(x.astype(float))
        index = SortedProjections(wide / scale[size], most[size], projections, size)
        needed = threshold(projections)
        for at, q in enumerate(questions.astype(float)):
            rows, scores = search(index, wide, least, q, float(bars[at]), k, scale[size], needed)
            yield at, rows, scores

    return find


def search_nearest(vectors: DataFrame, is_query: Column, k: int = 20, projections: int = PROJECTIONS, shard_rows: int = SHARD_ROWS,
                   query_rows: int = QUERY_ROWS, regions: int = REGIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: about the ``k`` largest inner products of each row that
    asks with every other row, in double precision, ties to the smaller vec_id.

    ``vectors`` are ``(vec_id, embedding)``. Rows with a null id or a vector that is null, empty, zero or
    holds a null or non-finite component take no part. Only vectors of one length are compared. A
    row repeated with its id counts as often as it stands there, never for its own id, and asks once.
    All rows are found where there are fewer than ``k``. Other columns are ignored. An empty table
    gives no rows.
    """
    wide = F.col("embedding").cast("array<double>")
    ready = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("x"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & finite(F.col("x"))).withColumn("largest", F.array_max(F.transform("x", F.abs))).where("largest > 0")
    ready = ready.withColumn("dim", F.size("x"))
    scale = {r["dim"]: r["s"] for r in ready.groupBy("dim").agg(F.max("largest").alias("s")).collect()}
    square = F.lit(0.0)
    if scale:
        by_length = F.create_map(*[F.lit(v) for pair in scale.items() for v in pair])
        small = F.transform("x", lambda v: v / F.element_at(by_length, F.col("dim")))
        square = F.aggregate(small, F.lit(0.0), lambda a, v: a + v * v)
    most = {r["dim"]: math.sqrt(r["m"]) for r in ready.groupBy("dim").agg(F.max(square).alias("m")).collect()}
    return nearest(ready.select("vec_id", "x", "asks"), k, _finder(most, scale, projections), "double", shard_rows, query_rows, regions)


runs_on_workers(__name__)

"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by space (``llm.space``). Each shard builds a ball tree (centre and radius
per node). A question visits nodes in the order of the upper bound ``q.c + |q| r`` and stops when no
bound reaches its current kth score. The kth score of the shard where the question's own vector lies
is the starting bar in all other shards, and shards whose root bound is below it are not asked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import runs_on_workers
from llm.space import QUERY_ROWS, REGIONS, nearest

SHARD_ROWS = 4_096
LEAF_ROWS = 64
EXACT = 2.0**53


def quantised(vector: Column) -> Column:
    """``floor(256 x)`` of each component; null for a vector that is null or holds a null or a
    non-finite component."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(wide.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * 256.0).cast("bigint")))


class BallTree:
    """Nodes ``(centre, radius, first, last, left, right)`` over rows kept in tree order."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.span, self.child = [], [], [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            rows = vectors[self.order[first:last]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(away.max()))
            self.span.append((first, last))
            self.child.append([-1, -1])
            if parent >= 0:
                self.child[parent][side] = node
            if last - first > leaf_rows:
                one = rows[away.argmax()]
                other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                middle = (last - first) // 2  # halves by rank, so equal vectors split as well
                rank = np.argsort(rows @ (other - one), kind="stable")
                self.order[first:last] = self.order[first:last][rank]
                stack += [(first, first + middle, node, 0), (first + middle, last, node, 1)]
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)


def search_shard(least: np.ndarray, vectors: np.ndarray, queries: np.ndarray, bars: np.ndarray,
                 k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(question, rows, scores)``: the best ``k`` of a shard, ties to the smaller id; rows below the
    bar, the kth score already known, may be left out."""
    tree = BallTree(vectors)
    ids, rows = least[tree.order], vectors[tree.order]
    norms = np.sqrt((queries**2).sum(axis=1))
    bounds = queries @ tree.centres.T + norms[:, None] * tree.radii[None, :]
    bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * (tree.radii + np.sqrt((tree.centres**2).sum(axis=1))) + 1)
    for q in range(len(queries)):
        bound, bar, best = bounds[q], bars[q], []
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < bar:
                break
            left, right = tree.child[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            first, last = tree.span[node]
            scores = rows[first:last] @ queries[q]
            best += [(-scores[at], int(ids[first + at]), first + at) for at in np.flatnonzero(scores >= bar)]
            if len(best) > k:
                best = heapq.nsmallest(k, best)
            if len(best) == k:
                bar = max(bar, -max(best)[0])
        best.sort()
        yield q, tree.order[[at for _, _, at in best]], np.array([int(-s) for s, _, _ in best], np.int64)


def _huge(least: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Scores beyond what doubles hold exactly: whole numbers, kept within 64 bits."""
    low, high = -(2**63), 2**63 - 1
    rows = [[int(x) for x in v] for v in vectors]
    for at, query in enumerate(queries):
        q = [int(x) for x in query]
        scored = ((-min(high, max(low, sum(a * b for a, b in zip(q, v)))), i, r) for r, (i, v) in enumerate(zip(least.tolist(), rows)))
        best = heapq.nsmallest(k, scored)
        yield at, np.array([r for _, _, r in best], np.int64), np.array([-s for s, _, _ in best], np.int64)


def find(x: np.ndarray, least: np.ndarray, questions: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    rows, asked = x.astype(float), questions.astype(float)
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0))
    if largest * max(x.shape[1], 1) < EXACT:
        return search_shard(least, rows, asked, bars, k)
    return _huge(least, x, questions, k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
          regions: int = REGIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of each query row
    with every other row, ties to the smaller vec_id; fewer where there are fewer rows.

    ``vectors`` are ``(vec_id, embedding)``; components count as ``floor(256 x)``. Rows with a
    null id, a null vector, or a null or non-finite component take no part. Only vectors of
    one length are compared. A row repeated with its id is scored as often as it stands there,
    never against its own id, and asks once. Scores beyond 64 bits stop at the limit. Other columns
    are ignored. An empty table gives no rows.
    """
    ready = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("x"), is_query.alias("asks"))
    return nearest(ready.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()), k, find, "bigint", shard_rows, query_rows, regions)


runs_on_workers(__name__)

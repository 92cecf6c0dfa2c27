"""Vector codes: product quantisation with norm-of-sum bounds.

A vector is cut into parts, each part is named by the nearest entry of its codebook, and the
codebooks are refined by rounds of means. From the second assignment on, most parts are settled
by two bounds without looking at the other entries. A part keeps the distance to its entry and a
lower bound for all others, each with the round it was measured in (its stamp). All codebooks of
earlier rounds are kept, so a bound of round ``t`` is moved to round ``r`` by the net way an entry
went, ``|c_r - c_t|``. That is the norm of the sum of its steps: never more, and mostly less, than the
sum of the norms of the steps. Only where the bounds cross is the distance to the own entry measured anew, and only if they
still cross are all entries scanned.

Distances are compared as exact integers. Vectors never leave the tasks: each round is a map
over the rows, written with their bounds, and a sum of at most ``parts * entries`` rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinshelf.session import small
from llm.common import materialise, runs_on_workers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1_024
SLACK = 1e-9  # relative; above the rounding of a few double operations
EXACT = 2.0**53
MOST = 2**63 - 1
STEP_VALUES = 1 << 20
Books = dict[int, list[list[np.ndarray]]]  # by vector length: per round, per part, entries x components


def whole_components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that is null or holds a null or
    non-finite component."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(wide.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * float(scale)).cast("bigint")))


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(length * p // parts, length * (p + 1) // parts) for p in range(parts)]


def exact_type(x: np.ndarray, book: np.ndarray) -> type:
    """Doubles where they hold all squared distances exactly, else Python's integers."""
    largest = max(float(np.abs(a.astype(float)).max(initial=0)) for a in (x, book))
    return float if 4 * max(x.shape[1], 1) * largest**2 < EXACT else object


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries."""
    kind = exact_type(x, book)
    x, book = x.astype(kind), book.astype(kind)
    if kind is float:
        return (x**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * (x @ book.T)
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(2) if x.shape[1] else np.zeros((len(x), len(book)), object)


def own_squares(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    kind = exact_type(x, of)
    return ((x.astype(kind) - of.astype(kind)) ** 2).sum(1) if x.shape[1] else np.zeros(len(x))


def root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(float))


class Bounds:
    """Per row of one part: its entry, the distance to it, a lower bound for all other entries, and
    the rounds (stamps) both are of."""

    def __init__(self, entry: np.ndarray, near: np.ndarray, near_at: np.ndarray, far: np.ndarray, far_at: np.ndarray) -> None:
        self.entry, self.near, self.near_at, self.far, self.far_at = entry, near, near_at, far, far_at

    @classmethod
    def none(cls, n: int) -> Bounds:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, np.int64))

    def moved(self, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Both bounds at the last round, by the net displacement of the entries since their stamps."""
        upper, lower = self.near.copy(), self.far.copy()
        for stamp in np.union1d(self.near_at, self.far_at):
            away = root(own_squares(history[-1], history[stamp]))
            rows = self.near_at == stamp
            upper[rows] += away[self.entry[rows]]
            rows = self.far_at == stamp
            first = int(away.argmax())
            second = np.delete(away, first).max(initial=0.0)
            lower[rows] -= np.where(self.entry[rows] == first, second, away[first])
        return upper, lower

    def assign(self, x: np.ndarray, history: list[np.ndarray]) -> int:
        """Brings the entries to the last codebook of the history; the number of rows that had to
        scan all entries."""
        book, now = history[-1], len(history) - 1
        upper, lower = self.moved(history)
        lower -= SLACK * (1 + np.abs(np.where(np.isfinite(lower), lower, 0)))
        crossed = np.flatnonzero(~(upper + SLACK * (1 + np.where(np.isfinite(upper), upper, 0)) < lower))
        seen = crossed[np.isfinite(self.near[crossed])]
        self.near[seen] = root(own_squares(x[seen], book[self.entry[seen]]))
        self.near_at[seen] = now
        crossed = crossed[~(self.near[crossed] * (1 + SLACK) + SLACK < lower[crossed])]
        for at in range(0, len(crossed), 4_096):
            rows = crossed[at:at + 4_096]
            away = squares(x[rows], book)
            self.entry[rows] = best = away.argmin(1).astype(np.int64)  # the lower index among equals
            every = np.arange(len(rows))
            self.near[rows] = root(away[every, best])
            others = away.astype(float)
            others[every, best] = np.inf
            self.far[rows] = np.sqrt(others.min(1))
        self.near_at[crossed] = self.far_at[crossed] = now
        return len(crossed)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, vectors)`` of the vectors of a batch, by length, in steps of bounded size."""
    column = batch.column("v")
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step = max(1, STEP_VALUES // max(int(size), 1))
        for at in range(0, len(every), step):
            rows = every[at:at + step]
            values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            yield int(size), rows, values.reshape(len(rows), size)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), kind))


STATE = ("entry", "near", "near_at", "far", "far_at")
STATE_TYPES = (pa.int16(), pa.float64(), pa.int8(), pa.float64(), pa.int8())
STATE_SCHEMA = "entry array<smallint>, near array<double>, near_at array<tinyint>, far array<double>, far_at array<tinyint>"


def _bounds_of(batch: pa.RecordBatch, rows: np.ndarray, parts: int) -> list[Bounds]:
    if "entry" not in batch.schema.names:
        return [Bounds.none(len(rows)) for _ in range(parts)]
    held = [batch.column(c).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), parts) for c in STATE]
    wide = [held[0].astype(np.int64), held[1].copy(), held[2].astype(np.int64), held[3].copy(), held[4].astype(np.int64)]
    return [Bounds(*[w[:, p].copy() for w in wide]) for p in range(parts)]


def _assigner(history: Books, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [np.zeros((batch.num_rows, parts), t.to_pandas_dtype()) for t in STATE_TYPES]
            for size, rows, x in _matrices(batch):
                bounds = _bounds_of(batch, rows, parts)
                for p, (first, last) in enumerate(cuts(size, parts)):
                    bounds[p].assign(x[:, first:last], [book[p] for book in history[size]])
                    for array, name in zip(new, STATE):
                        array[rows, p] = getattr(bounds[p], name)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("vec_id", "label", "v")], *[_lists(a, t) for a, t in zip(new, STATE_TYPES)]],
                names=["vec_id", "label", "v", *STATE])

    return run


def _adder(parts: int):
    """Sums of the parts of each entry in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list[int]] = {}
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for size, rows, x in _matrices(batch):
                entries = batch.column("entry").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), parts)
                small_enough = float(np.abs(x.astype(float)).max(initial=0)) * len(rows) < EXACT
                wide = x if small_enough else x.astype(object)
                for p, (first, last) in enumerate(cuts(size, parts)):
                    order = np.argsort(entries[:, p], kind="stable")
                    used, starts, n = np.unique(entries[order, p], return_index=True, return_counts=True)
                    added = np.add.reduceat(wide[order, first:last], starts, axis=0).tolist()
                    for entry, count, values in zip(used.tolist(), n.tolist(), added):
                        key = (size, p, entry)
                        counts[key] = counts.get(key, 0) + count
                        before = sums.get(key)
                        sums[key] = values if before is None else [a + b for a, b in zip(before, values)]
        if sums:
            size, part, entry = zip(*sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(size, pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
                 pa.array([counts[k] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.list_(pa.decimal128(38, 0)))],
                names=["dim", "part", "entry", "n", "total"])

    return run


def _means(group: pa.Table) -> pa.Table:
    n = sum(group["n"].to_pylist())
    total = [int(sum(values)) // n for values in zip(*group["total"].to_pylist())]
    return pa.table({**{c: group[c].slice(0, 1) for c in ("dim", "part", "entry")}, "mean": pa.array([total], pa.list_(pa.int64()))})


def _errors(book: Books, digests: dict[int, str], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error, dims = np.zeros(batch.num_rows, object), np.zeros(batch.num_rows, np.int64)
            for size, rows, x in _matrices(batch):
                entries = batch.column("entry").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), parts)
                dims[rows] = size
                for p, (first, last) in enumerate(cuts(size, parts)):
                    square = own_squares(x[:, first:last], book[size][-1][p][entries[:, p]])
                    error[rows] += np.array([int(s) for s in square], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("entry"), pa.array([min(e, MOST) for e in error], pa.int64()),
                 pa.array([digests[d] for d in dims.tolist()], pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for part in book for x in part.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes ``(vec_id, label, code, error, codebooks_sha256)`` and the codebooks by vector length.

    ``vectors`` are ``(vec_id, embedding, label)``. Rows whose vector is null or holds a null or
    non-finite component are dropped. Components count as ``floor(scale * x)``, stopped at 64 bits.
    The first codebooks are the parts of the ``entries`` smallest vec_ids (null ids last, equal ids by
    vector), fewer where there are fewer rows. Vectors of different lengths are compressed apart, each
    length with codebooks of its own, which are the only thing the driver holds. A length that the
    parts do not divide is cut as evenly as can be. Repeated rows count as often as they stand
    there. An empty table gives no rows. Errors beyond 64 bits stop at the limit. Other columns are
    ignored.
    """
    kept = vectors.select("vec_id", "label", whole_components(F.col("embedding"), scale).alias("v")).where(F.col("v").isNotNull())
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = kept.withColumn("dim", F.size("v")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= entries)
    begun: dict[int, list] = {}
    for row in first.orderBy("dim", "at").select("dim", "v").collect():
        begun.setdefault(row["dim"], []).append(row["v"])
    history: Books = {}
    for size, rows in begun.items():
        book = np.array(rows, np.int64).reshape(len(rows), size)
        history[size] = [[book[:, a:b].copy() for a, b in cuts(size, parts)]]
    types = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    schema = ", ".join([*types, "v array<bigint>", STATE_SCHEMA])
    state = materialise(kept.mapInArrow(_assigner(history, parts), schema), "codes_0")
    for turn in range(rounds):
        sums = state.select("v", "entry").mapInArrow(_adder(parts), "dim int, part int, entry int, n bigint, total array<decimal(38,0)>")
        means = sums.groupBy("dim", "part", "entry").applyInArrow(_means, "dim int, part int, entry int, mean array<bigint>").collect()
        for size in history:
            history[size].append([book.copy() for book in history[size][-1]])
        for row in means:
            history[row["dim"]][-1][row["part"]][row["entry"]] = row["mean"]
        state = materialise(state.mapInArrow(_assigner(history, parts), schema), f"codes_{turn + 1}")
    books = {size: turns[-1] for size, turns in history.items()}
    digests = {size: digest(book) for size, book in books.items()}
    last = {size: [book] for size, book in books.items()}
    codes = state.select("vec_id", "label", "v", "entry").mapInArrow(
        _errors(last, digests, parts), ", ".join([*types, "code array<smallint>, error bigint, codebooks_sha256 string"]))
    return codes, books


def code_report(codes: DataFrame) -> DataFrame:
    """Codes as hex, with the error summed over the rows of a label (null labels together)."""
    codes = materialise(codes, "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    text = F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))))
    return codes.join(small(sums), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", text.alias("code"), "error", "label_error", "codebooks_sha256")


runs_on_workers(__name__)

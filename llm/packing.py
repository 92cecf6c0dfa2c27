"""Packing of token sequences: cutting stock over the histogram of piece lengths.

1. Map: texts become ids, and each document is cut: whole sequences first, what remains into
   half a sequence, a multiple of the grid, and a tail shorter than the grid. So there are
   few lengths, and all but the whole ones are at most half a sequence.
2. The histogram of lengths (no more rows than the grid allows) goes to the driver, where
   column generation finds how often to use which pattern of lengths.
3. Pieces of one length are ranked: numbered within hash buckets, plus the pieces of the
   buckets before. Rank and length alone give the sequence and the place in it, from a table
   of the patterns, so no sequence is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.common import bounded_batches, bucket, lean, materialise, runs_on_workers, text_or_empty
from llm.cutting_stock import solve
from llm.tokens import encoder

SEQUENCE = 1024
GRID = 16
PIECES_PER_BUCKET = 2_000
BATCH_CHARS = 4_000_000
PIECE = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint"


def cuts(tokens: int, sequence: int = SEQUENCE, grid: int = GRID) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    whole, rest = divmod(tokens, sequence)
    half = sequence // 2
    parts = [sequence] * whole
    if half and rest >= half:
        parts.append(half)
        rest -= half
    tail = rest % grid
    return parts + [p for p in (rest - tail, tail) if p]


def _cutter(path: str, separator: int, sequence: int, grid: int):
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            at, start, length, ids, total, held = [], [], [], [], [], 0
            for row, text in enumerate(batch.column(1)):
                data = encode(text.as_py()) + end
                first = 0
                for part in cuts(len(data) // 4, sequence, grid):
                    at.append(row)
                    start.append(first)
                    length.append(part)
                    ids.append(data[4 * first:4 * (first + part)])
                    total.append(len(data) // 4)
                    first += part
                held += len(data)
                if held > BATCH_CHARS:
                    yield _pieces(batch, at, start, length, ids, total)
                    at, start, length, ids, total, held = [], [], [], [], [], 0
            if at:
                yield _pieces(batch, at, start, length, ids, total)

    return run


def _pieces(batch, at, start, length, ids, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
         pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
        names=["doc_id", "start", "length", "ids", "doc_tokens"])


def cut_documents(docs: DataFrame, tokenizer: str, separator: int = 0, sequence: int = SEQUENCE,
                  grid: int = GRID) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens)``: ``ids`` are little-endian unsigned 32-bit."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(lean(_cutter(tokenizer, separator, sequence, grid), keep="encoders"),
                           PIECE.format(id=docs.schema["doc_id"].dataType.simpleString()))


class _Places:
    """Sequence and offset by (length, rank)."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, times in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                for _ in range(pattern[length]):
                    runs.setdefault(length, []).append((times, first, offset))
                    offset += length
            first += times
        self.table = {}
        for length, found in runs.items():
            begins = np.array([0, *accumulate(r[0] for r in found)][:-1])
            self.table[length] = begins, np.array([r[1] for r in found]), np.array([r[2] for r in found])

    def find(self, length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, order = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for value in np.unique(size):
            rows = size == value
            begins, first, place = self.table[int(value)]
            run = np.searchsorted(begins, order[rows], side="right") - 1
            sequence[rows] = first[run] + order[rows] - begins[run]
            offset[rows] = place[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})


def pack_documents(docs: DataFrame, tokenizer: str, separator: int = 0, sequence: int = SEQUENCE,
                   grid: int = GRID, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and the
    columns of ``carry``, expressions over a piece (by default its ``ids``).

    Null text is empty: a document of the separator alone. Every row of ``docs`` is packed,
    repeated ones as often as they stand there; a null doc_id stays null. Texts of any length
    are cut into bounded pieces. An empty table gives no rows. Other columns are ignored.
    """
    kept = {"ids": F.col("ids")} if carry is None else carry
    cut = cut_documents(docs, tokenizer, separator, sequence, grid)
    pieces = materialise(cut.select("doc_id", "start", "length", "doc_tokens",
                                    *[c.alias(n) for n, c in kept.items()]), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _Places(solve(histogram, sequence))
    place = F.pandas_udf(places.find, "sequence_id bigint, offset bigint")
    n_buckets = max(1, -(-sum(histogram.values()) // PIECES_PER_BUCKET))
    dealt = pieces.withColumn("_bucket", bucket(F.struct("doc_id", "start"), n_buckets))
    before = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select(
        "length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "doc_tokens")
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(before, ["length", "_bucket"])
    placed = ranked.withColumn("_at", place("length", F.col("_before") + F.col("_row") - 1))
    return placed.select("doc_id", "start", "length", *kept, "doc_tokens", "_at.sequence_id", "_at.offset")


runs_on_workers("llm.cutting_stock")
runs_on_workers(__name__)

"""Words of many texts at once, as hash arrays (numpy over UTF-8 bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from llm.common import runs_on_workers

CHUNK_BYTES = 400_000
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def byte_class(which: str) -> np.ndarray:
    """Table of bytes inside words: ``solid`` is all but the ASCII blanks, ``letters`` ASCII
    letters, digits and every byte of other characters."""
    inside = np.ones(256, bool)
    if which == "solid":
        inside[[32, 9, 10, 11, 12, 13]] = False
    else:
        inside[:128] = [chr(b).isalnum() for b in range(128)]
    return inside


def chunks(column: pa.Array, most: int = CHUNK_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` of runs of rows of about ``most`` bytes and at
    most ``most_rows`` rows; null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, first + most_rows)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


class Hashes:
    """Hash of any byte range of a text run, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, values: np.ndarray) -> None:
        n = len(data) + 1
        self.inverse = _powers(pow(_BASE, -1, 2**64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[data] * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix((self.sums[last] - self.sums[first]) * self.inverse[first])


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _kept.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base & _MASK, np.uint64)
        steps[0] = 1
        held = _kept[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, words before)``: byte ranges of the words, and for each text (and the
    end) the number of words before it. Words do not cross texts."""
    held = inside[data]
    n = len(data)
    edges = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    before[1:], before[:1] = held[:-1], False
    before[edges] = False
    after = np.empty(n, bool)
    after[:-1], after[n - 1:] = held[1:], False
    after[edges[edges > 0] - 1] = False
    first, last = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    return first, last, np.searchsorted(first, offsets, side="left")


runs_on_workers(__name__)

"""Sets of word shingles as sorted arrays of 54-bit ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from llm.common import runs_on_workers
from llm.words import Hashes, _mix, byte_class, byte_values, word_bounds

SIZE = 5
ROW_BITS = 10  # the low bits of a hash make room for the row while ids are sorted
ROWS = 1 << ROW_BITS


@dataclass
class ShingleSets:
    """Distinct ids of each text of a run, text by text and ascending within a text."""

    ids: np.ndarray
    row: np.ndarray
    sizes: np.ndarray
    digests: list[bytes | None]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> ShingleSets:
    """Sets of a run of at most ``ROWS`` texts. Words are folded to lower case (A-Z); fewer
    than ``size`` words are one shingle, none are the empty set, which has no digest."""
    n_rows = len(offsets) - 1
    first, last, before = word_bounds(data, offsets, byte_class("solid"))
    words = Hashes(data, byte_values(True)).of(first, last)
    count = np.diff(before)
    row = np.repeat(np.arange(n_rows), count)
    factor = pow(0xD1342543DE82EF95, 3, 2**64)
    powers = np.array([pow(factor, k, 2**64) for k in range(size)], np.uint64)
    n = max(len(words) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k:k + n] * powers[k]
    inside = row[:n] == row[size - 1:size - 1 + n]
    hashes, owner = [_mix(total[inside])], [row[:n][inside]]
    for r in np.flatnonzero((count > 0) & (count < size)):
        own = words[before[r]:before[r + 1]]
        hashes.append(_mix((own * powers[:len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))))
        owner.append(np.array([r]))
    low = np.uint64(ROWS - 1)
    keyed = (np.concatenate(hashes) & ~low) | np.concatenate(owner).astype(np.uint64)
    keyed.sort()
    if len(keyed):
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    of = (keyed & low).astype(np.uint16)
    order = np.argsort(of, kind="stable")
    ids, of = (keyed >> np.uint64(ROW_BITS))[order], of[order]
    sizes = np.bincount(of, minlength=n_rows)
    return ShingleSets(ids, of, sizes, _digests(ids, sizes))


def _digests(ids: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits of a set: sums of two mixes of its ids."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(ids * np.uint64(odd) + np.uint64(odd)), dtype=np.uint64)])
            for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    ends = np.cumsum(sizes)
    parts = np.stack([s[ends] - s[ends - sizes] for s in sums], axis=1).astype("<u8")
    return [p.tobytes() if n else None for p, n in zip(parts, sizes)]


runs_on_workers(__name__)

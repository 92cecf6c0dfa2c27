"""Cutting stock by column generation: how often to use which pattern of piece lengths.

The input is a histogram of lengths, so its size depends on the capacity and not on the
number of pieces.
"""

from __future__ import annotations

import numpy as np

GAP = 0.001  # stop when the linear program is this close to its lower bound


def _price(lengths: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack by dynamic programming: the pattern of the highest dual value."""
    useful = np.flatnonzero(duals > 1e-12)
    ell, value = lengths[useful], duals[useful]
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(ell, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], taken[room] = best[room - 1], -1
        if k := fitting[room]:
            gain = best[room - ell[:k]] + value[:k]
            top = int(gain.argmax())
            if gain[top] > best[room] + 1e-12:
                best[room], taken[room] = gain[top], top
    pattern, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        pattern[useful[taken[room]]] += 1
        room -= int(ell[taken[room]])
    return pattern, float(best[capacity])


def _linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the relaxed optimum uses each."""
    n = len(lengths)
    repeats = capacity // lengths
    patterns, inverse = np.diag(repeats.astype(float)), np.diag(1.0 / repeats)
    used = demand / repeats
    floor = float((lengths * demand).sum()) / capacity
    for _ in range(20 * n + 100):
        duals = inverse.sum(axis=0)
        pattern, worth = _price(lengths, duals, capacity)
        floor = max(floor, float(duals @ demand) / max(worth, 1.0))
        if worth <= 1 + 1e-9 or used.sum() <= (1 + gap) * floor:
            break
        change = inverse @ pattern
        steps = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        used = np.maximum(used - step * change, 0.0)
        used[out] = step
        patterns[:, out] = pattern
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
    return patterns, used


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of the pieces that rounding leaves; their number is bounded
    by the number of patterns."""
    open_bins: list[tuple[int, dict[int, int]]] = []
    by_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths):
        ell = int(lengths[i])
        for _ in range(int(left[i])):
            room = next((r for r in range(ell, capacity + 1) if by_room.get(r)), None)
            if room is None:
                at = len(open_bins)
                open_bins.append((capacity - ell, {ell: 1}))
            else:
                at = by_room[room].pop()
                held = open_bins[at][1]
                held[ell] = held.get(ell, 0) + 1
                open_bins[at] = (room - ell, held)
            by_room.setdefault(open_bins[at][0], []).append(at)
    return [(held, 1) for _, held in open_bins]


def solve(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)``: every piece is covered exactly once, no pattern exceeds
    ``capacity``. A piece of the full capacity is a pattern of its own."""
    if any(not 1 <= ell <= capacity for ell in histogram):
        raise ValueError("a piece is longer than the capacity, or empty")
    plan = [({ell: 1}, n) for ell, n in histogram.items() if ell == capacity and n]
    rest = sorted((ell, n) for ell, n in histogram.items() if ell < capacity and n)
    if not rest:
        return plan
    lengths, demand = np.array([r[0] for r in rest]), np.array([r[1] for r in rest])
    patterns, used = _linear_program(lengths, demand.astype(float), capacity, gap)
    times = np.floor(used + 1e-7).astype(np.int64)
    whole = np.rint(patterns).astype(np.int64)
    left = demand - whole @ times
    for at in np.flatnonzero(left < 0):  # a rounding error took one pattern too many
        for column in np.flatnonzero((whole[at] > 0) & (times > 0)):
            if left[at] >= 0:
                break
            times[column] -= 1
            left += whole[:, column]
    for column in np.flatnonzero(times):
        held = np.flatnonzero(whole[:, column])
        plan.append(({int(lengths[i]): int(whole[i, column]) for i in held}, int(times[column])))
    return plan + _best_fit(lengths, left, capacity)

"""Grammar inference: probabilistic automata from sample strings by state merging."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from llm.common import runs_on_workers

ALPHA = 0.05
LITERAL = 4  # leading characters that stay as they are
LONG = 512  # characters of a token that is scored by itself


def symbol(c: str) -> str:
    """The class of a character: hex letters, other letters by case, digits; signs as they are."""
    if c.isdigit():
        return "9"
    if c.isalpha():
        return ("a" if c in "abcdef" else "z") if c.islower() else ("A" if c in "ABCDEF" else "Z")
    return c


def symbols(text: str) -> list[str]:
    return [*text[:LITERAL], *map(symbol, text[LITERAL:])]


class Automaton:
    """States with counts: visits, ends, and by symbol the next state and how often it was taken."""

    def __init__(self, strings: list[str], alpha: float = ALPHA) -> None:
        self.visits, self.ends, self.next, self.taken = [0], [0], [{}], [{}]
        for text in strings:
            self._add(symbols(text))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self.size = max(2, len({s for n in self.next for s in n}))
        self.tables: _Tables | None = None

    def _add(self, sequence: list[str]) -> None:
        state = 0
        self.visits[0] += 1
        for s in sequence:
            if s not in self.next[state]:
                self.next[state][s] = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
                self.taken.append({})
            self.taken[state][s] = self.taken[state].get(s, 0) + 1
            state = self.next[state][s]
            self.visits[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """The two states end and go on alike, and so do the states they lead to."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n1, n2 = self.visits[p], self.visits[q]
            if self._differ(self.ends[p], n1, self.ends[q], n2):
                return False
            for s in self.taken[p].keys() | self.taken[q].keys():
                if self._differ(self.taken[p].get(s, 0), n1, self.taken[q].get(s, 0), n2):
                    return False
                if s in self.next[p] and s in self.next[q]:
                    stack.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Counts of the tree below ``b`` go to ``a``."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for s, child in self.next[q].items():
                self.taken[p][s] = self.taken[p].get(s, 0) + self.taken[q][s]
                if s in self.next[p]:
                    stack.append((self.next[p][s], child))
                else:
                    self.next[p][s] = child

    def _merge_states(self) -> None:
        kept, waiting = [0], deque((0, s) for s in sorted(self.next[0]))
        while waiting:
            parent, s = waiting.popleft()
            state = self.next[parent][s]
            if state in kept:
                continue
            twin = next((k for k in kept if self._compatible(k, state)), None)
            if twin is None:
                kept.append(state)
                waiting.extend((state, x) for x in sorted(self.next[state]))
            else:
                self.next[parent][s] = twin
                self._fold(twin, state)
                waiting.extend((k, x) for k in kept for x in sorted(self.next[k]) if self.next[k][x] not in kept)

    def log_likelihood(self, text: str) -> float:
        state, total = 0, 0.0
        for s in symbols(text):
            total += math.log((self.taken[state].get(s, 0) + 0.1) / (self.visits[state] + 0.1 * (self.size + 2)))
            state = self.next[state].get(s, state)
        return total

    def log_likelihoods(self, tokens: list[str]) -> np.ndarray:
        if self.tables is None:
            self.tables = _Tables(self)
        return in_steps(tokens, self.log_likelihood, self.tables.scores)


class _Tables:
    """An automaton's states that can be reached, as arrays over the bytes of a token."""

    def __init__(self, automaton: Automaton) -> None:
        reached, stack = {0: 0}, [0]
        while stack:
            for to in automaton.next[stack.pop()].values():
                if to not in reached:
                    reached[to] = len(reached)
                    stack.append(to)
        names = sorted({s for state in reached for s in automaton.next[state]})
        place = {s: i for i, s in enumerate(names)}
        self.go = np.tile(np.arange(len(reached))[:, None], (1, len(names) + 1))
        self.logs = np.empty(self.go.shape)
        for state, row in reached.items():
            taken, total = automaton.taken[state], automaton.visits[state] + 0.1 * (automaton.size + 2)
            self.logs[row] = math.log(0.1 / total)
            for s, to in automaton.next[state].items():
                self.go[row, place[s]] = reached[to]
            for s, n in taken.items():
                self.logs[row, place[s]] = math.log((n + 0.1) / total)
        unknown = len(names)
        self.literal = np.array([place.get(chr(b), unknown) for b in range(128)])
        self.classed = np.array([place.get(symbol(chr(b)), unknown) for b in range(128)])

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        state, total = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for at in range(rows.shape[1]):
            live = np.flatnonzero(sizes > at)
            code = (self.literal if at < LITERAL else self.classed)[rows[live, at]]
            total[live] += self.logs[state[live], code]
            state[live] = self.go[state[live], code]
        return total


def _matrix(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ASCII tokens as rows, padded, and their lengths."""
    sizes = np.array([len(t) for t in tokens])
    rows = np.zeros((len(tokens), int(sizes.max())), np.uint8)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer("".join(tokens).encode(), np.uint8)
    return rows, sizes


def in_steps(tokens: list[str], one, many) -> np.ndarray:
    """Scores of tokens: ASCII ones of usual length together, others by themselves."""
    usual = [i for i, t in enumerate(tokens) if len(t) <= LONG and t.isascii()]
    out = np.array([0.0] * len(tokens))
    for first in range(0, len(usual), 8_192):
        some = usual[first:first + 8_192]
        out[some] = many(*_matrix([tokens[i] for i in some]))
    for i in set(range(len(tokens))) - set(usual):
        out[i] = one(tokens[i])
    return out


class Background:
    """Frequencies of symbols in ordinary tokens. Pairs are not used: in a rare context a
    single odd token of the sample would explain itself."""

    def __init__(self, strings: list[str]) -> None:
        self.seen: dict[str, int] = {}
        for text in strings:
            for c in text:
                self.seen[symbol(c)] = self.seen.get(symbol(c), 0) + 1
        self.total = sum(self.seen.values())

    def log_likelihood(self, text: str) -> float:
        return sum(math.log((self.seen.get(symbol(c), 0) + 0.5) / (self.total + 6.0)) for c in text)

    def log_likelihoods(self, tokens: list[str]) -> np.ndarray:
        logs = np.array([math.log((self.seen.get(symbol(chr(b)), 0) + 0.5) / (self.total + 6.0)) for b in range(128)])
        return in_steps(tokens, self.log_likelihood, lambda rows, sizes: np.where(
            np.arange(rows.shape[1]) < sizes[:, None], logs[rows], 0.0).sum(1))


runs_on_workers(__name__)

"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, folded to lower case and hashed. The machine scores a
text by linear weights and learned pairwise interactions of the terms present. It is learned
from a bounded sample of labelled rows, over all terms that ``LEAST_ROWS`` of them have.

The fit takes full steps over the sample, with a penalty that pulls most of what is not beyond chance
to zero. A term in ``c`` rows has by chance a gradient of about ``sqrt(c p (1 - p)) / n``; its linear
weight must beat that ``LINEAR_BEYOND`` times, its factors, with the factors they meet in place of 1,
``FACTORS_BEYOND`` times. So a small sample keeps few terms instead of learning noise, and a term that
tells nothing alone stays for its pairs. After ``FIRST_STEPS`` only terms that are not zero go on, and
the last steps, with little penalty, give the kept terms their full weights. Scoring is one map over
the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import bounded_batches, held_out, lean, runs_on_workers
from llm.words import Hashes, byte_class, byte_values, chunks, word_bounds

TRAIN_ROWS = 6_000  # bounds of the labelled sample
TRAIN_CHARS = 16_000_000
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)  # bytes
LEAST_ROWS = 3
FACTORS = 4
FIRST_STEPS, STEPS, LAST_STEPS = 8, 50, 60
RATE, FACTOR_RATE = 0.1, 0.03
LINEAR_BEYOND, FACTORS_BEYOND = 3.5, 2.5
LAST_PENALTY = 0.1
BLOCK = 1 << 18  # occurrences of terms that a step holds at once
THRESHOLD = 0.3


def term_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of the terms of a run of texts, repeats included."""
    first, last, before = word_bounds(data, offsets, byte_class("letters"))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    hashes = Hashes(data, byte_values(True))
    terms, texts = [hashes.of(first, last)], [text]
    for size in BEGINNINGS:
        long = last - first > size
        terms.append(hashes.of(first[long], first[long] + size) + np.uint64(size))
        texts.append(text[long])
    return np.concatenate(texts), (np.concatenate(terms) % np.uint64(BUCKETS)).astype(np.int64)


class Machine:
    """Linear and pairwise weights of the kept terms."""

    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.terms, self.bias, self.linear, self.factors = terms, bias, linear, factors

    def without_zeros(self) -> Machine:
        on = (self.linear != 0) | (self.factors != 0).any(1)
        return Machine(self.terms[on], self.bias, self.linear[on], self.factors[on])

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability of the label by text, from distinct ``(text, place of a kept term)``."""
        z = self.bias + np.bincount(text, self.linear[term], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            z += 0.5 * (np.bincount(text, v, minlength=n) ** 2 - np.bincount(text, v * v, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Occurrences:
    """Which terms which texts have, by text and by term."""

    def __init__(self, text: np.ndarray, term: np.ndarray, n: int, m: int) -> None:
        by_text, by_term = np.argsort(text, kind="stable"), np.argsort(term, kind="stable")
        self.term, self.text = term[by_text].astype(np.int32), text[by_term].astype(np.int32)
        self.text_starts = np.searchsorted(text[by_text], np.arange(n + 1))
        self.term_starts = np.searchsorted(term[by_term], np.arange(m + 1))

    @staticmethod
    def _sums(values: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``values`` at the places of each run, in blocks of bounded size."""
        out = np.zeros((len(starts) - 1, values.shape[1]), np.float32)
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK, side="right")) - 1)
            full = first + np.flatnonzero(starts[first + 1:last + 1] > starts[first:last])
            if len(full):
                held = values[places[starts[first]:starts[last]]]
                out[full] = np.add.reduceat(held, starts[full] - starts[first], axis=0)
            first = last
        return out

    def by_text(self, values: np.ndarray) -> np.ndarray:
        return self._sums(values, self.term, self.text_starts)

    def by_term(self, values: np.ndarray) -> np.ndarray:
        return self._sums(values, self.text, self.term_starts)


class Moments:
    """Running means of gradients and of their squares, one for each term's linear weight and one for
    all its factors."""

    def __init__(self, terms: int, factors: int) -> None:
        self.mean, self.square, self.steps = np.zeros((terms, factors + 1), np.float32), np.zeros((terms, 2), np.float32), 0

    def step(self, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The direction, and the step per unit of it."""
        self.steps += 1
        squares = np.stack([gradient[:, 0] ** 2, (gradient[:, 1:] ** 2).mean(1) if gradient.shape[1] > 1 else 0 * gradient[:, 0]], 1)
        self.mean = 0.8 * self.mean + 0.2 * gradient
        self.square = 0.95 * self.square + 0.05 * squares
        return self.mean / (1 - 0.8**self.steps), 1 / (np.sqrt(self.square / (1 - 0.95**self.steps)) + 1e-5)

    def keep(self, on: np.ndarray) -> None:
        self.mean, self.square = self.mean[on], self.square[on]


def fit(terms: np.ndarray, text: np.ndarray, term: np.ndarray, label: np.ndarray, factors: int = FACTORS,
        epochs: int = STEPS, rate: float = RATE, seed: int = 1) -> Machine:
    """A machine from distinct ``(text, place of a term)`` and the labels of the texts."""
    n, m = len(label), len(terms)
    share = (label.sum() + 0.5) / (n + 1.0)
    bias, chance = float(np.log(share / (1 - share))), share * (1 - share)
    w = np.zeros((m, factors + 1), np.float32)
    w[:, 1:] = np.random.default_rng(seed).normal(0, 0.02, (m, factors))
    if not n or not m:
        return Machine(terms, bias, np.zeros(m), np.zeros((m, factors)))
    count = np.bincount(term, minlength=m).astype(np.float32)
    moments, of_bias, seen, active = Moments(m, factors), Moments(1, 0), Occurrences(text, term, n, m), np.arange(m)
    for turn in range(FIRST_STEPS + epochs + LAST_STEPS):
        if turn in (FIRST_STEPS, FIRST_STEPS + epochs):
            on = (w != 0).any(1)
            place = np.cumsum(on) - 1
            still = on[term]
            text, term, active = text[still], place[term[still]], active[on]
            w, count = w[on], count[on]
            moments.keep(on)
            seen = Occurrences(text, term, n, len(active))
        penalty = LAST_PENALTY if turn >= FIRST_STEPS + epochs else 1.0
        s = seen.by_text(np.column_stack([w, (w[:, 1:] ** 2).sum(1)]))
        z = bias + s[:, 0] + 0.5 * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1])
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        met = (s[:, 1:-1] ** 2).sum(1)
        sums = seen.by_term(np.column_stack([error, error[:, None] * s[:, 1:-1], met]).astype(np.float32))
        gradient = sums[:, :-1] / n
        gradient[:, 1:] -= w[:, 1:] * gradient[:, :1]
        direction, size = moments.step(gradient)
        linear_size, factor_size = rate * size[:, 0], rate / RATE * FACTOR_RATE * size[:, 1]
        w[:, 0] -= linear_size * direction[:, 0]
        w[:, 0] = np.sign(w[:, 0]) * np.maximum(np.abs(w[:, 0]) - linear_size * penalty * LINEAR_BEYOND * np.sqrt(count * chance) / n, 0)
        w[:, 1:] -= factor_size[:, None] * direction[:, 1:]
        length = np.sqrt((w[:, 1:] ** 2).sum(1))
        pull = factor_size * penalty * FACTORS_BEYOND * np.sqrt(sums[:, -1] * chance) / n
        w[:, 1:] *= np.maximum(1 - pull / np.maximum(length, 1e-12), 0)[:, None]
        direction, size = of_bias.step(np.array([[error.mean()]]))
        bias -= rate / RATE * FACTOR_RATE * float(direction[0, 0] * size[0, 0])
    whole = np.zeros((m, factors + 1))
    whole[active] = w
    return Machine(terms, bias, whole[:, 0], whole[:, 1:])


def _places(terms: np.ndarray) -> np.ndarray:
    places = np.full(BUCKETS, -1, np.int32)
    places[terms] = np.arange(len(terms))
    return places


def _kept_terms(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    text, term = term_rows(data, offsets)
    at = places[term]
    pairs = np.unique(text[at >= 0] * max(m, 1) + at[at >= 0])
    return pairs // max(m, 1), pairs % max(m, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of each text."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column(0)):
            text, term = term_rows(data, offsets)
            pairs = np.unique(text * BUCKETS + term)
            bounds = np.searchsorted(pairs // BUCKETS, np.arange(last - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(first, last - first),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs % BUCKETS).astype(np.int32)))], names=["label", "terms"])


def _sample(docs: DataFrame, labels: DataFrame, most: int, most_chars: int) -> DataFrame:
    """``(text, label)`` of at most ``most`` different labelled rows and, after the first, at most
    ``most_chars`` characters of text, taken by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    order = F.xxhash64("doc_id")
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("label")).orderBy(order, "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("place", order).withColumn(
        "mark", F.xxhash64("text"))
    sizes = rows.select("place", "mark", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).distinct().orderBy("place", "mark").limit(most)
    held, chosen = 0, []
    for row in sizes.collect():
        if held and held + row["chars"] > most_chars:
            break
        held += row["chars"]
        chosen.append((row["place"], row["mark"]))
    kept = docs.sparkSession.createDataFrame(pa.table({  # a table in Arrow form needs no Python workers to be read
        name: pa.array([key[at] for key in chosen], pa.int64()) for at, name in enumerate(("place", "mark"))}))
    return rows.join(F.broadcast(kept), ["place", "mark"]).dropDuplicates(["place", "mark"]).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_chars: int = TRAIN_CHARS) -> Machine:
    """A machine from the labelled rows that are not held out, within the bounds of the sample.
    Without labelled rows it scores every text by the prior."""
    bounded_batches(docs.sparkSession)
    held = _sample(docs, labels, most, most_chars).mapInArrow(lean(_features), "label bigint, terms array<int>").toArrow()
    label = held["label"].to_numpy()
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in held["terms"].chunks] or [np.empty(0, int)])
    term = np.concatenate([c.flatten().to_numpy() for c in held["terms"].chunks] or [np.empty(0, np.int32)])
    del held
    terms = np.flatnonzero(np.bincount(term, minlength=BUCKETS) >= LEAST_ROWS)
    term = _places(terms)[term]
    text = np.repeat(np.arange(len(label), dtype=np.int32), sizes)
    text, term = text[term >= 0], term[term >= 0]
    return fit(terms, text, term, label).without_zeros()


def _text_scores(machine: Machine, places: np.ndarray, texts: pa.Array) -> pa.Array:
    score = np.empty(len(texts))
    for first, last, data, offsets in chunks(texts):
        text, term = _kept_terms(data, offsets, places, len(machine.terms))
        score[first:last] = machine.scores(text, term, last - first)
    return pa.array(score)


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _places(machine.terms)
        for texts in batches:
            yield _text_scores(machine, places, texts)

    scored = lean(run)
    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "double")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    The score is a probability from 0 to 1; null and empty texts, and texts without known
    terms, get the prior. A null doc_id is not held out. Repeated rows are scored alike. An
    empty table gives no rows. Other columns are ignored.
    """
    scored = docs.select("doc_id", _scorer(machine)("text").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all columns. Only the text goes through
    Python. Null and empty texts have the score of the prior; of repeated rows all stay or all go; an
    empty table gives no rows."""
    return docs.where(_scorer(machine)("text") < THRESHOLD)


runs_on_workers(__name__)

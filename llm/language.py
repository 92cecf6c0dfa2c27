"""Language ID: script ranges narrow the candidates, Viterbi labels the spans.

Every word gets a score per language: its log probability among the words of the language,
or, for a word not met in training, the mean of its byte trigrams. The script of the word
rules out languages that do not use it. A Viterbi pass with a penalty for switching labels
the words of each text, so a mixed text gets spans; the language with the most letters is
the text's. Counts come from at most ``TRAIN_ROWS`` rows; labelling is one map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import held_out, runs_on_workers
from llm.words import Hashes, byte_values, chunks, word_bounds

TRAIN_ROWS = 20_000  # bound of the labelled sample
LANGUAGES = 64  # bound of the learned languages, the most frequent
WORDS, GRAMS = 1 << 17, 1 << 15
SWITCH = 12.0  # penalty of a change of language, in nats
LEAST_COUNT = 3
FLOOR = -6.0
COUNT_TASKS = 16

# First code points of script blocks, and a number for each script.
SCRIPTS = [(0x0000, 0), (0x0250, 9), (0x0370, 1), (0x0400, 2), (0x0530, 9), (0x0590, 3), (0x0600, 4), (0x0780, 9),
           (0x0900, 5), (0x0E00, 6), (0x0E80, 9), (0x1100, 7), (0x1200, 9), (0x1E00, 0), (0x1F00, 1), (0x2000, 9),
           (0x3040, 8), (0x3100, 9), (0x3400, 8), (0xA000, 9), (0xAC00, 7), (0xD7B0, 9), (0xF900, 8), (0xFB00, 9),
           (0x20000, 8), (0x30000, 9)]
N_SCRIPTS = 10
_STARTS = np.array([s for s, _ in SCRIPTS])
_NUMBER = np.array([n for _, n in SCRIPTS])


def letters_class() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[:128] = [chr(b).isalpha() for b in range(128)]
    return inside


def first_code_points(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    b = [data[np.minimum(first + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    low = [x & 0x3F for x in b]
    return np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]],
        (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3])


class Words:
    """Words of a run of texts: byte ranges, hashed word, script, and the hashed trigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.last, self.before = word_bounds(data, offsets, letters_class())
        self.word = (Hashes(data, byte_values(True)).of(self.first, self.last) % np.uint64(WORDS)).astype(np.int64)
        self.script = _NUMBER[np.searchsorted(_STARTS, first_code_points(data, self.first), side="right") - 1] \
            if len(self.first) else np.empty(0, np.int64)
        folded = data.astype(np.int64)
        folded[(data >= 65) & (data <= 90)] += 32
        self.grams = ((folded[:-2] * 961 + folded[1:-1]) * 961 + folded[2:]) % (GRAMS - 1) if len(data) > 2 else np.empty(0, np.int64)


def _counter(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(languages)
        words, grams, scripts = np.zeros(WORDS * k), np.zeros(GRAMS * k), np.zeros(N_SCRIPTS * k)
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for first, last, data, offsets in chunks(batch.column(0)):
                found = Words(data, offsets)
                of = np.repeat(lang[first:last], np.diff(found.before))
                words += np.bincount(found.word * k + of, minlength=len(words))
                scripts += np.bincount(found.script * k + of, minlength=len(scripts))
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, found.first, 1)
                np.add.at(inside, np.maximum(found.last - 2, found.first), -1)
                gram = np.flatnonzero(np.cumsum(inside)[:len(found.grams)] > 0)
                owner = lang[first:last][np.searchsorted(offsets, gram, side="right") - 1]
                grams += np.bincount(found.grams[gram] * k + owner, minlength=len(grams))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()]) for x in (words, grams, scripts)],
                                         names=["words", "grams", "scripts"])

    return run


class Model:
    """Log scores by word and by trigram, relative to the best language, and scripts used."""

    def __init__(self, languages: list[str], words: np.ndarray, grams: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        self.known = words.sum(axis=1) >= LEAST_COUNT
        self.words, self.grams = _relative(words), _relative(grams)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= 0.01
        self.prior = int(words.sum(axis=0).argmax()) if languages else -1


def _relative(counts: np.ndarray) -> np.ndarray:
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
    return np.maximum(logs - logs.max(axis=1, keepdims=True), FLOOR).astype(np.float32)


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from the rows with text and language that are not held out, at most ``most`` of
    them, taken by hash of the id."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sample = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id").select("text", "lang")
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in top)
    k = len(languages)
    if not k:
        return Model([], np.zeros((WORDS, 1)), np.zeros((GRAMS, 1)), np.zeros((N_SCRIPTS, 1)))
    counts = rows.where(F.col("lang").isin(languages)).repartition(COUNT_TASKS).mapInArrow(
        _counter(languages), "words binary, grams binary, scripts binary").toArrow()
    sums = [sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in counts[c]).reshape(-1, k)
            for c in ("words", "grams", "scripts")]
    return Model(languages, *sums)


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    found = Words(data, offsets)
    scores = model.words[found.word]
    new = np.flatnonzero(~model.known[found.word])
    if len(new) and len(found.grams):
        first, last = found.first[new], np.maximum(found.last[new] - 2, found.first[new])
        first, last = np.minimum(first, len(found.grams)), np.minimum(last, len(found.grams))
        for k in range(scores.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(model.grams[found.grams, k], dtype=np.float64)])
            scores[new, k] = (sums[last] - sums[first]) / np.maximum(last - first, 1) * 2
    allowed = model.uses[found.script]
    ruled = allowed.any(axis=1)
    scores = np.where(ruled[:, None], np.where(allowed, scores, 4 * FLOOR), 0).astype(np.float32)
    return found, scores


def viterbi(scores: np.ndarray, before: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; all texts advance together, word by word, longest first."""
    sizes = np.diff(before)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = before[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
    k = scores.shape[1]
    back = np.empty(scores.shape, np.uint8)
    own = np.arange(k, dtype=np.uint8)
    labels = np.empty(len(scores), np.uint8)
    value, last = np.zeros((len(sizes), k), np.float32), np.zeros(len(sizes), np.int64)
    for t in range(longest):
        n = active[t]
        v, at = value[:n], begin[:n] + t
        if t:
            source = v.argmax(axis=1)
            moved = v[np.arange(n), source] - switch
            stay = v >= moved[:, None]
            back[at] = np.where(stay, own, source[:, None])
            v = np.where(stay, v, moved[:, None])
        value[:n] = v + scores[at]
    if longest:
        last = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = last[:n]
        if t:
            last[:n] = back[at, last[:n]]
    return labels


def _labeller(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _labelled(model, batch)

    return run


def _labelled(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    k, n = len(model.languages), batch.num_rows
    parts, scores, first, last, weight, counts = [], [], [], [], [], []
    texts = batch.column(1)
    for a, b, data, offsets in chunks(texts):
        if k:
            found, s = word_scores(model, data, offsets)
            scores.append(s)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = np.repeat(points[offsets[:-1]], np.diff(found.before))
            first.append(points[found.first] - base)
            last.append(points[found.last] - base)
            counts.append(np.diff(found.before))
    pred, score, spans = np.full(n, -1), np.zeros(n), pa.array([[]] * n, SPANS)
    if k and n:
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        first, last = np.concatenate(first), np.concatenate(last)
        labels = viterbi(np.concatenate(scores), before)
        row = np.repeat(np.arange(n), np.diff(before))
        letters = np.bincount(row * k + labels, last - first, minlength=n * k).reshape(n, k)
        total = letters.sum(axis=1)
        pred = np.where(total > 0, letters.argmax(axis=1), -1)
        score = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
        plain = np.flatnonzero(~_has_ascii_letters(batch))
        for at in plain:  # words of other characters may hold no letter at all
            if not any(c.isalpha() for c in texts[int(at)].as_py() or ""):
                pred[at], score[at] = -1, 0.0
            elif pred[at] < 0:
                pred[at], score[at] = model.prior, 1.0 / k
        edge = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])])) if len(labels) else np.empty(0, int)
        stop = (np.append(edge[1:], len(labels))[:len(edge)] - 1).astype(np.int64)
        values = pa.StructArray.from_arrays(
            [pa.array(first[edge], pa.int64()), pa.array(last[stop], pa.int64()),
             pa.array(np.array(model.languages, object)[labels[edge]] if len(edge) else [], pa.string())], names=["start", "end", "lang"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[edge], np.arange(n + 1)), pa.int32()), values)
    names = [model.languages[p] if p >= 0 else "und" for p in pred]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(score), spans],
                                      names=["doc_id", "lang_pred", "score", "spans"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _has_ascii_letters(batch: pa.RecordBatch) -> np.ndarray:
    found = np.zeros(batch.num_rows, bool)
    letters = letters_class()
    letters[128:] = False
    for a, b, data, offsets in chunks(batch.column(1)):
        held = np.concatenate([[0], np.cumsum(letters[data])])
        found[a:b] = held[offsets[1:]] > held[offsets[:-1]]
    return found


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, spans)``, one row per row of ``docs``.

    ``spans`` are ``(start, end, lang)`` in code points, from the first to the last word of a
    run of one language. ``score`` is the share of the letters in spans of ``lang_pred``, 0
    for ``und``: null texts, texts without a letter, or a model that has learned nothing. A
    text whose script no learned language uses gets the most frequent one with score 1/n.
    Repeated rows are labelled alike; an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    labelled = docs.select("doc_id", "text").mapInArrow(_labeller(model), (
        f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"))
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


runs_on_workers(__name__)

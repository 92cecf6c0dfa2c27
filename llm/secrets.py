"""Secret scans: fixed patterns, and automata that score the format of every other token.

The fixed patterns (assignments, access keys, hex runs) give the base spans. Their values,
labelled by kind, are the sample for grammar inference: a prefix tree per kind whose
statistically compatible states are merged. Every other token that is as long as the shortest of them is scored by
the automata against the ordinary tokens of the corpus; what fits a credential's format far
better is a span of kind ``format``. The sample is bounded; scanning is one map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.automata import Automaton, Background
from llm.common import runs_on_workers, text_or_empty
from llm.spans import SPANS, Span, span_lists
from llm.words import chunks, word_bounds

KINDS = ["assign", "access", "hex"]
ALL_KINDS = [*KINDS, "format"]
SAMPLE = 1_500  # bounds of the sample strings of each kind, and of the ordinary tokens
SAMPLE_CHARS = 100_000
SAMPLE_PARTS = 64
MARGIN = 12.0  # nats by which a format has to beat the ordinary tokens

# The patterns and lengths of the base kinds.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
LEAST = {"assign": 12, "access": 18, "hex": 16}
LEAST_TOKEN = min(LEAST.values())
TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


def _bytes_in(members: bytes) -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[list(members)] = True
    return inside


def _runs(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    first, last, _ = word_bounds(data, offsets, members)
    long = last - first >= least
    return first[long], last[long]


def _positions(data: bytes, word: bytes) -> list[int]:
    found, at = [], data.find(word)
    while at >= 0:
        found.append(at)
        at = data.find(word, at + 1)
    return found


def find_base(text: str) -> list[tuple[str, int, int, str]]:
    """Spans and values of the assignments and access keys of one text."""
    found = [("assign", m.start(), m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST["assign"]]
    return found + [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)
                    if len(m.group()) >= LEAST["access"]]


class Scan:
    """Base spans and the remaining tokens of a run of texts."""

    def __init__(self, texts: pa.Array, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        self.base: list[list[tuple[str, int, int, str]]] = [[] for _ in range(n)]
        raw, folded = data.tobytes(), data.copy()
        folded[(data >= 65) & (data <= 90)] += 32
        low = folded.tobytes()
        hits = [p for w in KEYWORDS for p in _positions(low, w)] + _positions(raw, b"AKIA")
        for row in np.unique(np.searchsorted(offsets, hits, side="right") - 1) if hits else []:
            self.base[row] += find_base(texts[first + int(row)].as_py() or "")
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.tokens: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        for members, least, to in ((b"0123456789abcdef", LEAST["hex"], "hex"), (TOKEN_BYTES, LEAST_TOKEN, None)):
            begins, ends = _runs(data, offsets, _bytes_in(members), least)
            rows = np.searchsorted(offsets, begins, side="right") - 1
            start, end = points[begins] - points[offsets[rows]], points[ends] - points[offsets[rows]]
            for row, a, b, p, q in zip(rows.tolist(), begins.tolist(), ends.tolist(), start.tolist(), end.tolist()):
                value = raw[a:b].decode()
                if to:
                    self.base[row].append((to, p, q, value))
                else:
                    self.tokens[row].append((p, q, value))
        for row in range(n):
            if self.tokens[row] and self.base[row]:
                self.tokens[row] = [t for t in self.tokens[row]
                                    if not any(s <= t[0] and t[1] <= e for _, s, e, _ in self.base[row])]


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each kind, and the ordinary tokens."""
    for batch in batches:
        kinds, values = [], []
        for first, _, data, offsets in chunks(batch.column(0)):
            scan = Scan(batch.column(0), first, data, offsets)
            for base, tokens in zip(scan.base, scan.tokens):
                kinds += [b[0] for b in base]
                values += [b[3] for b in base]
                kinds += ["ordinary"] * len(tokens)
                values += [t[2] for t in tokens]
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


class Formats:
    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.automata = [Automaton(samples[k]) for k in KINDS if samples.get(k)]
        self.background = Background(samples.get("ordinary", []))

    def margins(self, tokens: list[str]) -> np.ndarray:
        """How much likelier each token is as a credential, in nats."""
        if not self.automata or not tokens:
            return np.full(len(tokens), -np.inf)
        best = np.max([a.log_likelihoods(tokens) for a in self.automata], axis=0)
        return best - self.background.log_likelihoods(tokens)


def learn(docs: DataFrame, most: int = SAMPLE) -> Formats:
    """Automata from at most ``most`` distinct values of each kind, whole, and after the first at most
    ``SAMPLE_CHARS`` characters of them, taken by hash. Hashed parts of a kind are cut first."""
    values = docs.select(text_or_empty().alias("text")).mapInArrow(_sampler, "kind string, value string").distinct()
    values = values.withColumn("part", F.pmod(F.xxhash64("value", F.lit(1)), F.lit(SAMPLE_PARTS)))
    order = [F.xxhash64("value"), F.col("value")]
    held = F.sum(F.length("value"))

    def cut(rows: DataFrame, *by: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        sized = rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most)
        return sized.withColumn("held", held.over(window.rowsBetween(Window.unboundedPreceding, 0))).where(
            (F.col("held") <= SAMPLE_CHARS) | (F.col("place") == 1)).drop("place", "held")

    picked = cut(cut(values, "kind", "part"), "kind")
    samples: dict[str, list[str]] = {}
    for row in picked.orderBy("kind", "value").collect():
        samples.setdefault(row["kind"], []).append(row["value"])
    return Formats(samples)


def _scanner(formats: Formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[Span]] = []
            for first, _, data, offsets in chunks(batch.column(1)):
                scan = Scan(batch.column(1), first, data, offsets)
                distinct = sorted({v for tokens in scan.tokens for _, _, v in tokens}, key=len)
                fits = {v for v, m in zip(distinct, formats.margins(distinct)) if m >= MARGIN}
                for base, tokens in zip(scan.base, scan.tokens):
                    rows.append([(k, s, e, True) for k, s, e, _ in base]
                                + [("format", s, e, False) for s, e, v in tokens if v in fits])
            yield pa.RecordBatch.from_arrays([batch.column(0), span_lists(rows, ALL_KINDS)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``.

    Spans are in code points. Base spans are the leftmost, non-overlapping matches of their
    kind that are long enough; spans of kind ``format`` are not part of a base span, but may have one
    in them. Null and empty texts have none. Spans of different kinds may overlap and are all given. Repeated
    rows are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanner(formats), f"doc_id {id_type}, spans {SPANS}")


runs_on_workers(__name__)

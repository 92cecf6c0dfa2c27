"""Personal data: anchors found by Aho-Corasick, expanded by local parsers.

One automaton finds every at-sign, plus sign, digit, address scheme and account cue of a
text. From each anchor a parser for its kind expands as far as its characters go and
validates what it has: email addresses from the at-sign both ways, phone numbers from the
plus sign, IP addresses and card numbers from the first digit, addresses with credentials
from the scheme, account numbers from the cue. Parsers never look back beyond the last span
of their kind, so a text is read in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import runs_on_workers, worker_cache
from llm.spans import SPANS, Span, span_lists

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "address", "account"]
CUES = ["iban", "account", "acct", "konto", "compte", "cuenta"]
SCHEMES = ["http://", "https://", "ftp://"]

# The characters, patterns and lengths of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255

USER = re.compile(r"[A-Za-z0-9._~%!$&*+=-]+:[^\s/@\"'<>]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr)\b\.?)?\x20?[:#]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}|[0-9](?:[\x20-]?[0-9]){7,16})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    plain = value.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


class Parsers:
    """Parsers of one text; ``free`` is where the next span of each kind may begin."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self.free = dict.fromkeys(ALL_KINDS, 0)

    def take(self, kind: str, start: int, end: int, valid: bool) -> None:
        self.free[kind] = end
        if valid:
            self.spans.append((kind, start, end, kind in KINDS))

    def at_sign(self, at: int) -> None:
        first = at
        while first > self.free["email"] and self.text[first - 1] in LOCAL:
            first -= 1
        if first < at and (m := DOMAIN.match(self.text, at)):
            self.take("email", first, m.end(), True)

    def digit(self, at: int) -> None:
        if at >= self.free["card"] and (m := CARD.match(self.text, at)):
            digits = _digits(m.group())
            self.take("card", at, m.end(), CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits))
        follows = at > 0 and self.text[at - 1] in "0123456789"
        if not follows and at >= self.free["ip"] and (m := IP.match(self.text, at)):
            parts = m.group().split(".")
            self.take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_PART for p in parts))

    def plus(self, at: int) -> None:
        if at >= self.free["phone"] and (m := PHONE.match(self.text, at)):
            self.take("phone", at, m.end(), PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1])

    def scheme(self, at: int, end: int) -> None:
        if at >= self.free["address"] and (m := USER.match(self.text, end)):
            self.take("address", at, m.end(), True)

    def cue(self, at: int, end: int) -> None:
        if at >= self.free["account"] and (m := ACCOUNT.match(self.text, end)):
            value = m.group(1)
            self.take("account", m.start(1), m.end(1), iban(value) if value[:2].isalpha() else True)


def _automaton():
    import ahocorasick

    held = worker_cache("anchors")
    if "automaton" not in held:
        automaton = ahocorasick.Automaton()
        for sign, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789")]:
            automaton.add_word(sign, (kind, 1))
        for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
            for word in words:
                for form in {word, word.upper(), word.capitalize()}:
                    automaton.add_word(form, (kind, len(form)))
        automaton.make_automaton()
        held["automaton"] = automaton
    return held["automaton"]


def find(text: str, automaton) -> list[Span]:
    parsers = Parsers(text)
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "digit":
            parsers.digit(at)
        elif kind == "at":
            parsers.at_sign(at)
        elif kind == "plus":
            parsers.plus(at)
        elif kind == "scheme":
            parsers.scheme(at, last + 1)
        else:
            parsers.cue(at, last + 1)
    return parsers.spans


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        rows = [find(text.as_py() or "", automaton) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), span_lists(rows, ALL_KINDS)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``, one row per row of ``docs``.

    Spans are in code points. Base kinds are the leftmost, non-overlapping matches of each
    kind that pass their check; ``address`` is an address with user and password, ``account``
    a number after a cue. Null and empty texts have none; spans of different kinds may
    overlap and are all given. Repeated rows are scanned alike; an empty table gives no rows;
    other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_finder, f"doc_id {id_type}, spans {SPANS}")


runs_on_workers(__name__)

"""Token ids of the byte-level BPE file, with a memory of words already encoded."""

from __future__ import annotations

import re

import numpy as np

from llm.common import runs_on_workers, worker_cache

WORDS_KEPT = 400_000  # bound of the memory of one Python worker

# The word pattern and the byte letters of this vocabulary family.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
# Texts of these characters only, where ``re`` and the tokenizer agree on letters, digits and blanks.
PLAIN = r"[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*"


def _byte_letters() -> dict[int, str]:
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Word -> its ids as little-endian bytes."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelled = "".join(map(self.letters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Words are split off as the tokenizer does and encoded by its model once each. Texts with
    other characters than ``PLAIN``, or with the string of a special token, are left to the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)
        self.split, self.plain = re.compile(WORD).findall, re.compile(PLAIN).fullmatch

    def encode(self, text: str) -> bytes:
        if self.plain(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    held = worker_cache("encoders")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


runs_on_workers(__name__)

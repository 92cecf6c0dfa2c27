"""Text preparation: cleaned text, tokens, stop words, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinshelf.functions.stop_words import ENGLISH
from kinshelf.params import ModelParams


def strip(text: Column) -> Column:
    """Trim every Unicode white space; Spark's ``trim`` only knows the blank."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def lowered(title: Column, description: Column, authors: Column, categories: Column) -> Column:
    """Lower-cased ``title description authors categories``. Its words are those of ``letters_only``, since a word
    ends at anything but a letter, and finding them takes one pass over the text instead of two."""
    parts = [F.coalesce(part, F.lit("")) for part in (title, description, authors, categories)]
    return F.lower(F.concat_ws(" ", *parts))


def letters_only(title: Column, description: Column, authors: Column, categories: Column) -> Column:
    """Lower-cased ``title description authors categories`` with non-letters blanked."""
    return F.regexp_replace(lowered(title, description, authors, categories), r"[^a-zA-Z\s]", " ")


def clean_text(title: Column, description: Column, authors: Column, categories: Column) -> Column:
    raw = letters_only(title, description, authors, categories)
    return strip(squeeze(raw))


def stop_words(params: ModelParams) -> list[str]:
    return list(ENGLISH) if params.stop_words is None else list(params.stop_words)


def _pieces(letters: Column) -> Column:
    return F.split(F.regexp_replace(letters, r"[^a-z]+", " "), " ")


def words(letters: Column) -> Column:
    """Tokens of at least two letters, in text order; the text is lower-cased."""
    return F.filter(_pieces(letters), lambda w: F.length(w) >= 2)


def content_words(letters: Column, stop: list[str]) -> Column:
    """Tokens without stop words. ``isin`` becomes a hash-set test."""
    if not stop:
        return words(letters)
    return F.filter(_pieces(letters), lambda w: (F.length(w) >= 2) & ~w.isin(stop))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs. They bridge removed stop words, since those are gone already."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(tokens: Column, ngram_max: int = 2) -> Column:
    """Bag union of unigrams and bigrams."""
    if ngram_max not in (1, 2):
        raise ValueError("ngram_max is 1 or 2")
    return F.concat(tokens, bigrams(tokens)) if ngram_max == 2 else tokens

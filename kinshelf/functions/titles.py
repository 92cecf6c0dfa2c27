"""Title keys, sanitising and the two duplicate rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinshelf.functions.text import squeeze, strip

# Fixed value: the quote and dash spellings the service rejects or deletes.
FORBIDDEN = r"(?i)'|\\x27|\\x2D\\x2D|%27|%2D%2D"

UNKNOWN_AUTHOR = "Unknown"
PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}]"


def title_key(title: Column) -> Column:
    return strip(F.lower(title))


def author_key(authors: Column) -> Column:
    return strip(F.lower(F.coalesce(authors, F.lit(UNKNOWN_AUTHOR))))


def sanitise(text: Column, most: int | None = None) -> Column:
    """Search form of a query: forbidden spellings deleted, white space squeezed. ``most``
    cuts it to so many characters; by default it stays whole."""
    kept = strip(squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), FORBIDDEN, "")))
    return kept if most is None else strip(F.substring(kept, 1, most))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def plain_title(key: Column) -> Column:
    """Title key without punctuation, as the simple duplicate rule compares it."""
    return F.regexp_replace(key, PUNCTUATION, "")


def title_words(plain: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain, r"[\s\p{Z}]+"), lambda w: w != ""))


def same_title(a: Column, b: Column, profile: str) -> Column:
    """Whether two works of one author are the same work.

    ``a`` and ``b`` are structs with ``key`` (production) or ``plain`` and ``words``
    (simple). The caller has already matched the authors.
    """
    if profile == "production":
        return either_contains(a["key"], b["key"])
    common = F.size(F.array_intersect(a["words"], b["words"]))
    overlap = (common >= 2) & (
        (common / F.size(a["words"]) > 0.7) | (common / F.size(b["words"]) > 0.7)
    )
    return either_contains(a["plain"], b["plain"]) | overlap


def title_form(key: Column, profile: str) -> Column:
    """The struct ``same_title`` compares, derived from a title key."""
    if profile == "production":
        return F.struct(key.alias("key"))
    plain = plain_title(key)
    return F.struct(plain.alias("plain"), title_words(plain).alias("words"))


def is_duplicate(author_a: Column, title_a: Column, author_b: Column, title_b: Column,
                 profile: str = "production") -> Column:
    """Duplicate test on four plain columns."""
    forms = title_form(title_key(title_a), profile), title_form(title_key(title_b), profile)
    return (author_key(author_a) == author_key(author_b)) & same_title(*forms, profile)

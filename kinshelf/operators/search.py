"""Keyword search over title, authors, description and categories, for a batch of terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinshelf.functions.display import display
from kinshelf.functions.titles import title_key
from kinshelf.operators.containment import needles_in_haystacks
from kinshelf.operators.gram_index import GramIndex
from kinshelf.session import materialise, union_all

FIELDS = ("title", "authors", "description", "categories")
# Separates the fields in the text the grams are taken from; the hit test looks at each field.
BETWEEN = "\u0001"
FIRST_SHARE = 64  # the first of so many equal ranges of ids is searched first


def searchable(catalogue: DataFrame) -> DataFrame:
    """The four fields in lower case, whole, and all of them in one text."""
    lowered = catalogue.select("id", *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS])
    return lowered.select("*", F.concat_ws(BETWEEN, *FIELDS).alias("all_fields"))


def text_grams(catalogue: DataFrame, path: str) -> GramIndex:
    """The stored index of all four fields."""
    return GramIndex.build(searchable(catalogue).select("id", F.col("all_fields").alias("text")), path, anchored=False)


def search_hits(requests: DataFrame, catalogue: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """``(request_id, hit, id)``: per request ``(request_id, term, hits)`` the first hits by id.
    With an ``index``, no grams of the catalogue are made.

    A blank term finds nothing. A request for no hit or fewer still gets one, as in the
    service being matched, whose check follows the append.
    """
    asked = materialise(requests.select(
        "request_id", title_key(F.col("term")).alias("key"), F.greatest("hits", F.lit(1)).alias("hits"),
    ).where(F.col("key") != ""), "asked")
    keys = materialise(asked.groupBy("key").agg(F.max("hits").alias("most")), "keys")
    most = keys.agg(F.max("most")).first()[0] or 1

    def in_a_field():
        tests = [F.contains(F.col(f), F.col("key")) for f in FIELDS]
        return tests[0] | tests[1] | tests[2] | tests[3]

    by_id = Window.partitionBy("key").orderBy("id")

    def first_hits(pairs: DataFrame) -> DataFrame:
        # A pair met through several grams has one id and so one dense rank.
        return pairs.select("key", "id").select("*", F.dense_rank().over(by_id).cast("bigint").alias("hit")).where(
            F.col("hit") <= most).distinct()

    def upto(keys: DataFrame, last: Column) -> DataFrame:
        """First hits among the books up to an id, from the stored grams."""
        pairs = index.around(keys.select("key"), "key").where(F.col("id") <= last).distinct()
        texts = searchable(catalogue.where(F.col("id") <= last)).drop("all_fields")
        return first_hits(pairs.join(texts, "id").where(in_a_field()))

    if index is None:
        passes = [first_hits(pairs) for pairs in needles_in_haystacks(keys, "key", "key", searchable(catalogue), "all_fields", in_a_field)]
    else:
        # Hits go by id: a key that has all its hits among the lowest ids needs no look at the others.
        low, high = catalogue.agg(F.min("id"), F.max("id")).first()
        if low is None:
            low = high = 0
        early = materialise(upto(keys, F.lit(low + (high - low) // FIRST_SHARE)), "early_hits")
        full = early.groupBy("key").agg(F.count("*").alias("n")).join(keys, "key").where(F.col("n") >= F.col("most")).select("key")
        full = materialise(full, "full_keys")
        passes = [early.join(full, "key", "left_semi"), upto(keys.join(full, "key", "left_anti"), F.lit(high))]
    if not passes:
        return asked.select("request_id", F.lit(0).cast("bigint").alias("hit"), F.lit(None).cast("bigint").alias("id")).limit(0)
    return asked.join(union_all(passes), "key").where(F.col("hit") <= F.col("hits")).select(
        "request_id", "hit", "id")


def search(requests: DataFrame, catalogue: DataFrame, record: Callable[[DataFrame], DataFrame] = display,
           index: GramIndex | None = None) -> DataFrame:
    """Search results with their records, attached after the hits are cut down."""
    return search_hits(requests, catalogue, index).join(record(catalogue), "id")

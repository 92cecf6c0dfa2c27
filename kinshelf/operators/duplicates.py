"""Works that count as the same: pairs of one author, met through shared parts of their titles.

No author's works are compared pair by pair. A title inside another shares a gram with it; titles
that share most words share one of the rarest words of either. A word that very many works of an
author have is split by salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinshelf.functions.titles import title_form
from kinshelf.operators.containment import contained
from kinshelf.session import materialise, spread

# The rule of the service being matched.
LEAST_COMMON, LEAST_SHARE = 2, 0.7
WORKS_PER_SALT = 2_000


def work_key(author: Column, title: Column) -> Column:
    """One short key for an author key and a title key."""
    return F.md5(F.concat_ws("\u0001", author, title))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def enough_words(common: Column, a: Column, b: Column) -> Column:
    return (common >= LEAST_COMMON) & ((common / F.size(a) > LEAST_SHARE) | (common / F.size(b) > LEAST_SHARE))


def _prefix(words: Column) -> Column:
    """The words of which a title with enough in common has at least one: all but so many that
    the rest alone is too few."""
    n = F.size(words)
    needed = F.greatest(F.floor(n * LEAST_SHARE) + 1, F.lit(LEAST_COMMON))
    return F.slice(words, 1, F.greatest(n - needed + 1, F.lit(0)).cast("int"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left, right)`` works of one author with enough words in common.

    Both sides are ``(work, author_key, words)``, one row per work. Words are ranked by the number of
    the author's works on the right that have them, rare ones first.
    """
    words = right.select("author_key", F.explode("words").alias("word"))
    counts = words.groupBy("author_key", "word").agg(F.count("*").alias("n"))

    def ranked(works: DataFrame) -> DataFrame:
        one = works.select("work", "author_key", F.explode("words").alias("word")).join(counts, ["author_key", "word"], "left")
        item = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")
        return one.groupBy("work", "author_key").agg(F.sort_array(F.collect_list(item)).alias("items"))  # the words of one title

    def salted(items: Column) -> Column:
        return F.greatest(F.ceil(items["n"] / WORKS_PER_SALT), F.lit(1)).cast("int")

    def rows(works: DataFrame, name: str, part: Column) -> DataFrame:
        out = works.select(F.col("work").alias(name), "author_key", F.transform("items", lambda i: i["word"]).alias(f"{name}_words"),
                           F.explode(part).alias("item"))
        return out.select(name, "author_key", f"{name}_words", F.col("item.word").alias("word"), salted(F.col("item")).alias("salts"))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64(name), F.col("salts")).cast("int")).drop("salts")

    def copied(df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    key = ["author_key", "word", "salt"]
    a, b = ranked(left), ranked(right)
    of_left = copied(rows(a, "left", _prefix(F.col("items")))).join(dealt(rows(b, "right", F.col("items")), "right"), key)
    of_right = copied(rows(a, "left", F.col("items"))).join(dealt(rows(b, "right", _prefix(F.col("items"))), "right"), key)
    common = shared_words(F.col("left_words"), F.col("right_words"))
    met = of_left.unionByName(of_right).where(enough_words(common, F.col("left_words"), F.col("right_words")))
    return met.select("left", "right").distinct()


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left, right)`` works of one author where either title lies in the other, each pair once. Both sides
    are ``(work, author_key, form)``."""
    a = left.select(F.col("work").alias("left"), "author_key", F.col("form").alias("left_form"))
    b = right.select(F.col("work").alias("right"), "author_key", F.col("form").alias("right_form"))
    inside = contained(a, "left_form", b, "right_form", ["author_key"])
    around = contained(b, "right_form", a, "left_form", ["author_key"]).where(F.col("left_form") != F.col("right_form"))
    return inside.select("left", "right").unionByName(around.select("left", "right"))


def same_works(left: DataFrame, right: DataFrame, profile: str) -> DataFrame:
    """``(left, right)`` keys of works that count as the same under a profile's rule.

    Both sides are ``(work, author_key, title_key)`` with one row per work; a work on both sides is
    the same as itself.
    """
    def formed(works: DataFrame) -> DataFrame:
        form = title_form(F.col("title_key"), profile)
        if profile == "production":
            return works.select("work", "author_key", form["key"].alias("form"))
        return works.select("work", "author_key", form["plain"].alias("form"), form["words"].alias("words"))

    left, right = materialise(spread(formed(left)), "left_works"), materialise(spread(formed(right)), "right_works")
    found = containing(left, right)
    if profile == "production":
        return found
    return found.unionByName(overlapping(left, right)).distinct()


def works_in(books: DataFrame) -> DataFrame:
    """``(work, author_key, title_key)`` of ``(author_key, title_key)`` rows, each once."""
    return books.select("author_key", "title_key").distinct().select(
        work_key(F.col("author_key"), F.col("title_key")).alias("work"), "author_key", "title_key")


def blocked_works(blockers: DataFrame, books: DataFrame, profile: str) -> DataFrame:
    """``(source_id, work)``: the works that are duplicates of a work ``(author_key, title_key)`` of a source."""
    keyed = blockers.select("source_id", work_key(F.col("author_key"), F.col("title_key")).alias("left")).distinct()
    pairs = same_works(works_in(blockers), works_in(books), profile)
    return keyed.join(pairs, "left").select("source_id", F.col("right").alias("work")).distinct()

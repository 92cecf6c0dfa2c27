"""The denormalised catalogue: books with their author and category lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinshelf.functions.titles import title_key
from kinshelf.sources.tables import live

BOOK_COLUMNS = ["id", "title", "slug", "cover_local_path", "description", "average_rating", "rating_count"]


def eligible(books: DataFrame, language: str = "en") -> DataFrame:
    """Books with a title and a description in one language."""
    return books.where(
        F.col("description").isNotNull() & (F.col("description") != "")
        & F.col("title").isNotNull() & (F.col("language") == language)
    )


def book_links(books: DataFrame, links: DataFrame, member_id: str) -> DataFrame:
    """books left-joined to one link table."""
    return books.join(links, F.col("id") == F.col("canonical_book_id"), "left").select(
        "id", F.col(member_id)
    )


def linked_names(links: DataFrame, members: DataFrame, member_id: str) -> DataFrame:
    """Links with the name of a live member; deleted members leave the name null."""
    named = live(members).select(F.col("id").alias(member_id), "name")
    return links.join(named, member_id, "left").select("canonical_book_id", member_id, "name")


def name_list(links: DataFrame, members: DataFrame, member_id: str, alias: str) -> DataFrame:
    """One row per book: its distinct member names in binary order, joined by ``|``.

    Duplicates are removed per (book, name) first, so a book with very many links is
    spread over tasks before its list is put together.
    """
    pairs = linked_names(links, members, member_id).where(F.col("name").isNotNull())
    pairs = pairs.select("canonical_book_id", "name").distinct()
    return pairs.groupBy("canonical_book_id").agg(
        F.array_join(F.sort_array(F.collect_list("name")), "|").alias(alias)
    ).withColumnRenamed("canonical_book_id", "id")


def load_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue rows.

    Each link table is reduced to one row per book before it meets the books, so the two
    many-to-many branches never multiply. The lists are narrow: where they are small the
    joins broadcast them and descriptions stay in place, else both joins use one shuffle.
    """
    books = eligible(live(tables["books_with_details"])).select(*BOOK_COLUMNS)
    authors = name_list(tables["book_authors"], tables["authors"], "author_id", "authors")
    categories = name_list(tables["book_categories"], tables["categories"], "category_id", "categories")
    joined = books.join(authors, "id", "left").join(categories, "id", "left")
    return joined.select(*BOOK_COLUMNS, "authors", "categories")


def group_books(books: DataFrame) -> DataFrame:
    """One row per distinct seven-column book row; nulls group together."""
    return books.select(*BOOK_COLUMNS).distinct()


def titles_index(catalogue: DataFrame) -> DataFrame:
    """title key -> first and last id. A lookup resolves to the last, ties go by the first."""
    keyed = catalogue.select(title_key(F.col("title")).alias("title_key"), "id")
    return keyed.groupBy("title_key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))

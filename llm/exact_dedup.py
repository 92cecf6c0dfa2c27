"""Exact dedup: salted combining of digest groups, comparing whole texts at every stage.

1. Local: within a map task, rows of equal (digest, text) become one row with the smallest
   doc_id and a count (the map-side half of the first aggregation).
2. Salted: the rows of a digest meet in ``salts`` groups dealt by the map task they come
   from, so no group of copies, however large, meets in one task at once.
3. Global: the winners of the salts meet, one row per text and salt.

The digest and the whole text are the grouping key of both aggregations, so texts are
compared in full at each stage. What then returns to the documents is narrow: the digest
tells the group, unless stage 3 saw two texts under one digest; those rows alone are joined
by text. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kinshelf.session import small
from llm.common import BLANKS, materialise, text_or_empty

SALTS = 64
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: str = "text") -> Column:
    """Every run of blanks becomes one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def digest(normal: Column) -> Column:
    return F.sha2(F.encode(normal, "UTF-8"), 256)


def groups(docs: DataFrame, salts: int = SALTS, key: Callable[[Column], Column] = digest) -> DataFrame:
    """``(text_sha256, normal, keep_id, group_size)``, one row per distinct normalised text,
    dealt by digest."""
    texts = docs.select("doc_id", normalised().alias("normal")).select(
        "doc_id", "normal", key(F.col("normal")).alias("text_sha256"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = texts.groupBy("text_sha256", "normal", "salt").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.repartition("text_sha256").groupBy("text_sha256", "normal").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS, key: Callable[[Column], Column] = digest) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Null text counts as empty; blanks at the ends stay one space. Of equal texts the
    smallest doc_id stays (null only if all of the group are null). Rows that repeat a
    doc_id and its text are one document written several times: each counts in
    ``group_size``, and ``kept`` is the same for all of them. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    by_digest = groups(docs, salts, key).groupBy("text_sha256").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    shared = materialise(by_digest.where("group_size > 1"), "dedup_groups")
    labels = _labels(docs, shared.where("texts = 1").drop("texts"), ["text_sha256"], key)
    if shared.where("texts > 1").isEmpty():
        return labels
    # Different texts under one digest: those rows alone are matched by text.
    clash = shared.where("texts > 1").select("text_sha256")
    rows = docs.select("doc_id", "text").withColumn("text_sha256", key(normalised()))
    rows = rows.join(clash, "text_sha256", "left_semi")
    by_text = groups(docs, salts, key).join(clash, "text_sha256", "left_semi")
    return labels.join(clash, "text_sha256", "left_anti").select(*COLUMNS).unionByName(
        _labels(rows, by_text, ["text_sha256", "normal"], key))


def _labels(docs: DataFrame, found: DataFrame, on: list[str], key: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select("doc_id", key(normalised()).alias("text_sha256"), normalised().alias("normal"))
    alone = F.col("group_size").isNull()
    return rows.select("doc_id", *on).join(found, on, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; a repeated row stays once."""
    labels = materialise(exact_dedup(docs), "dedup_labels")
    gone = labels.where(~F.col("kept")).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    same = (F.col("doc_id").eqNullSafe(F.col("_gone_id"))) & (digest(normalised()) == F.col("_gone_text"))
    stay = docs.join(small(gone), same, "left_anti")
    repeated = labels.where(F.col("kept") & (F.col("group_size") > 1)).groupBy("doc_id", "text_sha256").agg(
        F.count("*").alias("n")).where("n > 1")
    return stay if repeated.isEmpty() else stay.dropDuplicates(["doc_id", "text"])

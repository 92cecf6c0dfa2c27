"""A stored index of the character grams of texts, for substring questions in both directions.

Built once with the model: postings ``(gram, id)`` of all grams of ``SIZE`` characters, or a given size, of the padded
texts, their counts, and for each text its anchor, the rarest gram of the text itself. Postings and anchors are bucketed and
sorted by gram, so a lookup reads them where they lie, without an exchange on their side and
without making the grams of any stored text.

A needle is looked up by its rarest gram alone; a needle shorter than a gram by all grams around
it. A haystack meets, with each of its grams, the texts anchored there. Every meeting is verified by
the caller on the texts themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE = 3
PAD = "\u0002"  # around texts, so that their ends and the shortest texts have grams as well
BUCKETS = 64


def grams(text: Column, size: int = SIZE) -> Column:
    """Distinct pieces of ``size`` characters, in time linear in the text."""
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(F.substring(text, 1 + o, 1 << 30), F.lit("(?s)(.{%d})" % size), F.lit(1)) for o in range(size)]))


def padded(text: Column, size: int = SIZE) -> Column:
    ends = F.lit(PAD * (size - 1))
    return F.concat(ends, text, ends)


def pieces(text: Column, size: int = SIZE) -> Column:
    """Distinct pieces of every length up to a gram, the empty one included."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[grams(text, n) for n in range(1, size + 1)]))


def _rows(df: DataFrame, made: Column, *keep: str) -> DataFrame:
    """One row per gram; the outer form keeps the optimiser from making the grams twice."""
    return df.select(*keep, F.explode_outer(made).alias("gram")).where(F.col("gram").isNotNull())


def _table(spark: SparkSession, path: str, id_type: str, buckets: int) -> DataFrame:
    name = "grams_" + hashlib.md5(path.encode()).hexdigest()[:20]
    if not spark.catalog.tableExists(name):
        spark.sql(f"create table {name} (gram string, id {id_type}) using parquet "
                  f"clustered by (gram) sorted by (gram) into {buckets} buckets location '{path}'")
    return spark.table(name)


def _store(rows: DataFrame, path: str, buckets: int) -> None:
    """Bucketed files; dealing the rows by gram first makes one file a bucket."""
    name = "grams_" + hashlib.md5(path.encode()).hexdigest()[:20]
    rows.repartition(buckets, "gram").write.bucketBy(buckets, "gram").sortBy("gram").option("path", path).saveAsTable(name)


@dataclass
class GramIndex:
    """Tables of one collection of texts ``(id, text)``, ids unique."""

    postings: DataFrame
    counts: DataFrame
    anchors: DataFrame | None
    size: int = SIZE

    @classmethod
    def build(cls, texts: DataFrame, path: str, buckets: int = BUCKETS, anchored: bool = True, size: int = SIZE) -> GramIndex:
        """Stores the tables; without ``anchored`` only what ``around`` needs."""
        spark, id_type = texts.sparkSession, texts.schema["id"].dataType.simpleString()
        _store(_rows(texts.where(F.col("text").isNotNull()), grams(padded(F.col("text"), size), size), "id"), f"{path}/postings", buckets)
        stored = _table(spark, f"{path}/postings", id_type, buckets)
        stored.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
        if not anchored:
            return cls.open(spark, path, id_type, buckets, anchored, size)
        whole = ~F.col("gram").contains(PAD)
        rare = stored.where(whole).join(spark.read.parquet(f"{path}/counts"), "gram").groupBy("id").agg(
            F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        short = texts.where(F.length("text") < size).select(F.col("text").alias("gram"), "id")
        _store(rare.select("gram", "id").unionByName(short), f"{path}/anchors", buckets)
        return cls.open(spark, path, id_type, buckets, size=size)

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = BUCKETS, anchored: bool = True,
             size: int = SIZE) -> GramIndex:
        return cls(_table(spark, f"{path}/postings", id_type, buckets), spark.read.schema("gram string, n bigint").parquet(f"{path}/counts"),
                   _table(spark, f"{path}/anchors", id_type, buckets) if anchored else None, size)

    def _rarest(self, needles: DataFrame, needle: str) -> DataFrame:
        """``(needle, gram)``: the rarest gram of each needle that has one."""
        long = _rows(needles.where(F.length(needle) >= self.size), grams(F.col(needle), self.size), needle)
        return long.join(self.counts, "gram", "left").groupBy(needle).agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))

    def around(self, needles: DataFrame, needle: str) -> DataFrame:
        """``(needle, id)`` of texts that may contain a needle of ``needles``, which are distinct and not
        empty."""
        parts = _rows(self.counts.withColumn("whole", F.col("gram")), pieces(F.col("gram"), self.size), "whole")
        short = needles.where(F.length(needle) < self.size).withColumn("gram", F.col(needle)).join(
            parts, "gram").select(needle, F.col("whole").alias("gram"))
        return self.postings.join(self._rarest(needles, needle).unionByName(short), "gram").select(needle, "id")

    def around_long(self, needles: DataFrame, needle: str) -> DataFrame:
        """As ``around`` for needles of at least a gram, without a look at the pieces of the stored grams."""
        return self.postings.join(self._rarest(needles, needle), "gram").select(needle, "id")

    def within(self, haystacks: DataFrame, haystack: str) -> DataFrame:
        """``(haystack, id)`` of texts that may lie in one of ``haystacks``, which are distinct."""
        rows = _rows(haystacks, pieces(F.col(haystack), self.size), haystack)
        return self.anchors.join(rows, "gram").select(haystack, "id")

"""Resolving title queries: exact key, else containment either way, else a scan of the titles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinshelf.functions.titles import either_contains, title_key
from kinshelf.operators.containment import haystacks_around_needles, needles_in_haystacks
from kinshelf.operators.gram_index import GramIndex
from kinshelf.session import materialise, small, spread, union_all


def exact_matches(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``(key, source_id)``; a title shared by several books resolves to the last one.

    Both sides have one row per key, so no key is hot.
    """
    return titles.join(small(queries.select("key")), F.col("title_key") == F.col("key")).select(
        "key", F.col("last_id").alias("source_id"))


def containment_matches(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """``(key, source_id)`` of the first title, in catalogue order, inside the key or around it."""
    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("key").agg(F.min(F.struct("first_id", "last_id")).alias("best"))

    keys = queries.select("key").distinct()
    inside = needles_in_haystacks(keys, "key", "key", titles, "title_key")
    around = haystacks_around_needles(keys, "key", "key", titles, "title_key")
    found = [best(p) for p in inside] + [best(p) for p in around]
    if not found:
        return keys.select("key", F.lit(None).cast("bigint").alias("source_id")).limit(0)
    return union_all(found).groupBy("key").agg(F.min("best").alias("best")).select(
        "key", F.col("best.last_id").alias("source_id"))


def scan_matches(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(scan_key, source_id)``: lowest id whose lower-cased title contains the raw query."""
    titles = catalogue.groupBy(F.lower("title").alias("lower_title")).agg(F.min("id").alias("id"))
    keys = queries.select("scan_key").distinct()
    pairs = needles_in_haystacks(keys, "scan_key", "scan_key", titles, "lower_title")
    found = [p.groupBy("scan_key").agg(F.min("id").alias("id")) for p in pairs]
    if not found:
        return keys.select("scan_key", F.lit(None).cast("bigint").alias("source_id")).limit(0)
    return union_all(found).groupBy("scan_key").agg(F.min("id").alias("source_id"))


LONG_GRAM = 8  # characters; as titles get more, so do their long grams, and few titles have the rarest one


@dataclass
class TitleIndex:
    """Stored grams of the titles: ``texts`` is ``(id, lower_title, title_key)``, the first id of each
    spelling in lower case; ``grams`` and ``long_grams`` are indexes of ``lower_title``, for needles shorter than
    a long gram and the others; ``anchors`` has the long grams of ``title_key``."""

    texts: DataFrame
    grams: GramIndex
    long_grams: GramIndex
    anchors: GramIndex

    @staticmethod
    def title_texts(catalogue: DataFrame) -> DataFrame:
        spelled = catalogue.groupBy(F.lower("title").alias("lower_title")).agg(F.min("id").alias("id"))
        return spelled.select("id", "lower_title", title_key(F.col("lower_title")).alias("title_key"))

    @classmethod
    def build(cls, catalogue: DataFrame, path: str) -> TitleIndex:
        spark = catalogue.sparkSession
        cls.title_texts(catalogue).write.parquet(f"{path}/texts")
        texts = spark.read.parquet(f"{path}/texts")
        lowered = texts.select("id", F.col("lower_title").alias("text"))
        GramIndex.build(lowered, f"{path}/grams", anchored=False)
        GramIndex.build(lowered, f"{path}/long_grams", anchored=False, size=LONG_GRAM)
        keys = texts.groupBy("title_key").agg(F.min("id").alias("id"))
        GramIndex.build(keys.select("id", F.col("title_key").alias("text")), f"{path}/anchors", size=LONG_GRAM)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TitleIndex:
        texts = spark.read.schema("id bigint, lower_title string, title_key string").parquet(f"{path}/texts")
        return cls(texts, GramIndex.open(spark, f"{path}/grams", anchored=False),
                   GramIndex.open(spark, f"{path}/long_grams", anchored=False, size=LONG_GRAM), GramIndex.open(spark, f"{path}/anchors", size=LONG_GRAM))

    def around(self, needles: DataFrame, needle: str) -> DataFrame:
        """``(needle, id)`` of titles that may contain a needle of ``needles``, which are distinct and not empty."""
        long = F.length(needle) >= LONG_GRAM
        return self.long_grams.around_long(needles.where(long), needle).unionByName(self.grams.around(needles.where(~long), needle))

    def containment_matches(self, queries: DataFrame, titles: DataFrame) -> DataFrame:
        """As ``containment_matches``, from stored grams."""
        keys = materialise(spread(queries.select("key").distinct()), "asked_keys")
        full = keys.where(F.col("key") != "")
        met = self.around(full, "key").unionByName(self.anchors.within(full, "key")).distinct()
        pairs = materialise(met, "met").join(self.texts, "id").where(either_contains(F.col("title_key"), F.col("key"))).select("key", "title_key").distinct()
        first = F.min(F.struct("first_id", "last_id"))
        found = pairs.join(titles, "title_key").groupBy("key").agg(first.alias("best"))
        blank = titles.agg(first.alias("best")).where(F.col("best").isNotNull()).select(F.lit("").alias("key"), "best")
        return found.unionByName(keys.where(F.col("key") == "").join(blank, "key")).select("key", F.col("best.last_id").alias("source_id"))

    def scan_matches(self, queries: DataFrame) -> DataFrame:
        """As ``scan_matches``, from stored grams."""
        keys = materialise(spread(queries.select("scan_key").distinct()), "asked_scans")
        met = self.around(keys.where(F.col("scan_key") != ""), "scan_key").distinct()
        found = met.join(self.texts, "id").where(F.contains("lower_title", "scan_key")).groupBy("scan_key").agg(F.min("id").alias("source_id"))
        blank = self.texts.agg(F.min("id").alias("source_id")).where(F.col("source_id").isNotNull()).select(F.lit("").alias("scan_key"), "source_id")
        return found.unionByName(keys.where(F.col("scan_key") == "").join(blank, "scan_key"))


def resolve(requests: DataFrame, titles: DataFrame, catalogue: DataFrame | None, index: TitleIndex | None = None) -> DataFrame:
    """``(request_id, source_id, stage)`` for ``(request_id, key, scan_key)``; no row if not found.

    Equal queries are resolved once. Each stage only sees what the stages before it left.
    Without ``catalogue`` the third stage is skipped. With an ``index``, no grams of titles are made.
    """
    # Each stage is written, so that no plan holds another one: the driver keeps every plan several times while it runs.
    queries = materialise(requests.select("key", "scan_key").distinct(), "queries")
    exact = materialise(exact_matches(queries.select("key").distinct(), titles), "exact")
    rest = materialise(queries.join(exact, "key", "left_anti"), "rest")
    near = materialise(index.containment_matches(rest, titles) if index else containment_matches(rest, titles), "near")
    by_key = exact.select("key", "source_id", F.lit(1).alias("stage")).unionByName(
        near.select("key", "source_id", F.lit(2).alias("stage")))
    found = requests.join(by_key, "key").select("request_id", "source_id", "stage")
    if catalogue is None:
        return found
    last = materialise(rest.join(near, "key", "left_anti"), "last")
    scanned = materialise(index.scan_matches(last) if index else scan_matches(last, catalogue), "scanned").select("scan_key", "source_id", F.lit(3).alias("stage"))
    late = requests.join(last, ["key", "scan_key"]).join(scanned, "scan_key")
    return found.unionByName(late.select("request_id", "source_id", "stage"))

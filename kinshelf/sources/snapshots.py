"""Model snapshots: parquet folders under a fingerprint, with a manifest as commit log."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from kinshelf.functions.text import stop_words
from kinshelf.params import ModelParams, SNAPSHOT_TTL_HOURS
from kinshelf.plans.model import Model, build_indexes, build_model, with_indexes
from kinshelf.sources.digests import state_digest
from kinshelf.session import remove
from kinshelf.sources.tables import live

MANIFEST_SCHEMA = "snapshot_key string, path string, artefacts array<string>, created_at timestamp"


def data_fingerprint(books: DataFrame) -> DataFrame:
    """One row: number of live books, latest change, ``count_latest`` and its short hash.

    Empty tables give the word ``empty``, so that the key never depends on the clock.
    """
    latest = F.coalesce(F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("empty"))
    facts = live(books).agg(F.count("*").alias("books"), latest.alias("latest"))
    data_key = F.concat_ws("_", F.col("books").cast("string"), "latest")
    return facts.select("books", "latest", data_key.alias("data_key"),
                        F.substring(F.md5(data_key), 1, 8).alias("fingerprint"))


def config_hash(params: ModelParams) -> str:
    """Short hash of everything that shapes the model, the stop words included."""
    facts = {**asdict(params), "stop_words": stop_words(params)}
    return hashlib.md5(json.dumps(facts, sort_keys=True).encode()).hexdigest()[:8]


def snapshot_key(data_key: Column, config: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", data_key, config)), 1, 12)


def key_for(tables: dict[str, DataFrame], params: ModelParams, root: str | None = None) -> str:
    """Key of a state of all source tables and the parameters. Under ``root``, files are hashed once."""
    state = state_digest(tables, root)
    return hashlib.md5(f"{state}_{config_hash(params)}".encode()).hexdigest()[:12]


def valid_snapshots(manifest: DataFrame, as_of: Column, ttl_hours: int = SNAPSHOT_TTL_HOURS,
                    expected: int = len(Model.TABLES)) -> DataFrame:
    """Complete snapshots younger than the time to live; the age must be strictly below it."""
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    return manifest.where((F.size("artefacts") == expected) & (age < ttl_hours * 3_600_000_000))


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")
    except AnalysisException:
        return None


def save(build, spark: SparkSession, root: str, key: str) -> Model:
    """Run ``build(write)`` and commit the result under ``key``.

    The manifest row comes last. A build that fails half way leaves files no reader ever
    looks at; a second build under the same key takes over with its manifest row.
    """
    path = f"{root}/tables/{key}/{uuid.uuid4().hex}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    model = build_indexes(build(write), f"{path}/index")
    row = spark.range(1).select(
        F.lit(key).alias("snapshot_key"), F.lit(path).alias("path"),
        F.array(*[F.lit(name) for name in Model.TABLES]).alias("artefacts"),
        F.current_timestamp().alias("created_at"))
    row.write.mode("append").parquet(f"{root}/manifest")
    return model


def load(spark: SparkSession, root: str, key: str, params: ModelParams, as_of: Column | None = None,
         ttl_hours: int = SNAPSHOT_TTL_HOURS) -> Model | None:
    """The newest valid snapshot of ``key``; none if there is no such one."""
    manifest = read_manifest(spark, root)
    if manifest is None:
        return None
    as_of = F.current_timestamp() if as_of is None else as_of
    found = valid_snapshots(manifest.where(F.col("snapshot_key") == key), as_of, ttl_hours)
    row = found.agg(F.max_by("path", "created_at")).first()
    if row[0] is None:
        return None
    return with_indexes(Model(*[spark.read.parquet(f"{row[0]}/{name}") for name in Model.TABLES], params), f"{row[0]}/index")


def load_or_build(tables: dict[str, DataFrame], catalogue: DataFrame, params: ModelParams, root: str) -> Model:
    """Use the snapshot of the present data and parameters, or build it. ``tables`` are what the
    catalogue is made from; where they are files, a state seen before is known by its listing."""
    spark = catalogue.sparkSession
    key = key_for(tables, params, root)
    return load(spark, root, key, params) or save(
        lambda write: build_model(catalogue, params, write), spark, root, key)


def reload(tables: dict[str, DataFrame], catalogue: DataFrame, params: ModelParams, root: str) -> Model:
    """Build anew and let the new snapshot replace the old ones of its key, which go."""
    spark, key = catalogue.sparkSession, key_for(tables, params, root)
    manifest = read_manifest(spark, root)
    old = [] if manifest is None else [
        r["path"] for r in manifest.where(F.col("snapshot_key") == key).select("path").distinct().collect()]
    model = save(lambda write: build_model(catalogue, params, write), spark, root, key)
    for path in old:
        remove(spark, path)
    return model


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Stored files and megabytes per snapshot key; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(f"{root}/tables").select("path", "length")
    key = F.regexp_extract("path", "/tables/([^/]+)/", 1)
    return files.groupBy(key.alias("snapshot_key")).agg(
        F.count("*").alias("total_files"), (F.sum("length") / (1024 * 1024)).alias("total_size_mb"))


def model_stats(model: Model) -> DataFrame:
    """Book count, feature count and readiness in one row."""
    books = model.catalogue.agg(F.count("*")).scalar()
    return model.vocab.agg(F.count("*").alias("tfidf_features")).select(
        books.alias("books_count"), "tfidf_features", (F.col("tfidf_features") > 0).alias("ready"))

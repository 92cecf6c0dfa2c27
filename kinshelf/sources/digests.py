"""Digests of table contents that are kept per file, so that only new files are ever read.

The tree has three levels. A file has the number of its rows and the sum of their hashes, stored
under its path, length and change time. A table has the sums over its files, which do not depend on
how the rows are laid out. The key of a state is the digest of its tables. A state whose files are all known is keyed
from the listing alone; a file written anew is hashed again, the others are not.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = "path string, length bigint, modified timestamp, columns string, n bigint, total decimal(38,0)"
FILE = {"path": "file_path", "length": "file_size", "modified": "file_modification_time"}
FEW_FILES = 1_000


def _sums(rows: DataFrame) -> list:
    return [F.count("*").alias("n"), F.coalesce(F.sum(F.col("_hash").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total")]


def content(table: DataFrame) -> DataFrame:
    """One row: count and order-free hash sum of all rows."""
    rows = table.select(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).alias("_hash"))
    return rows.agg(*_sums(rows))


def file_rows(table: DataFrame) -> DataFrame | None:
    """The hash of each row and the file it is from; nothing for a table that is no plain file scan."""
    if not table.inputFiles():
        return None
    try:
        return table.select(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).alias("_hash"),
                            *[F.col(f"_metadata.{m}").alias(c) for c, m in FILE.items()])
    except AnalysisException:
        return None


def listing(table: DataFrame) -> DataFrame:
    """``(path, length, modified)`` of the files of a table; no file is opened."""
    files = table.sparkSession.read.format("binaryFile").load(table.inputFiles())
    return files.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in FILE.items()])


def known_entries(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).parquet(f"{store}/entries").dropDuplicates(["path", "length", "modified", "columns"])
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)


def table_digest(table: DataFrame, store: str | None) -> str:
    """``rows_hash`` of a table. With a ``store``, only files without an entry there are read, once."""
    rows = file_rows(table) if store is not None else None
    if rows is None:
        return "_".join(str(x) for x in content(table).first())
    spark, key = table.sparkSession, list(FILE)
    columns = ",".join(f"{c}:{t}" for c, t in table.dtypes)

    def states() -> DataFrame:
        known = known_entries(spark, store).where(F.col("columns") == columns).select(*key, "n", "total")
        return listing(table).join(known, key, "left")

    def summed(found: DataFrame):
        return found.agg(F.sum("n"), F.sum("total"), F.count_if(F.col("n").isNull()), F.count("*")).first()

    n, total, fresh, files = summed(states())
    if fresh:
        new = states().where(F.col("n").isNull()).select(*key)
        if fresh < files and fresh <= FEW_FILES:  # the filter keeps all other files closed
            rows = rows.where(F.col("path").isin([r["path"] for r in new.select("path").collect()]))
        else:
            rows = rows.join(new.select("path"), "path", "left_semi")
        hashed = new.join(rows.groupBy(*key).agg(*_sums(rows)), key, "left").select(
            *key, F.lit(columns).alias("columns"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).cast("decimal(38,0)").alias("total"))
        hashed.write.mode("append").parquet(f"{store}/entries")
        n, total, _, _ = summed(states())
    return f"{n}_{total}"


def state_digest(tables: dict[str, DataFrame], store: str | None = None) -> str:
    """Digests of all tables by name, in one text."""
    return "_".join(f"{name}={table_digest(tables[name], store)}" for name in sorted(tables))

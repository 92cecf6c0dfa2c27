"""Reading the relational source tables from parquet or over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinshelf.schemas import TABLES, conform


def from_parquet(spark: SparkSession, folder: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")
        for name in names
    }


def from_jdbc(spark: SparkSession, url: str, options: Mapping[str, str],
              split_column: Mapping[str, str], names=tuple(TABLES), partitions: int = 64) -> dict[str, DataFrame]:
    """Read the tables in parallel key ranges; filters and columns are pushed to the database.

    ``split_column`` names a numeric column per table to split on. Its range is asked for
    first (one row), so that every executor reads one slice.
    """
    tables = {}
    for name in names:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        column = split_column.get(name)
        if column is None:
            tables[name] = conform(reader.option("dbtable", name).load(), TABLES[name])
            continue
        low, high = reader.option("query", f"select min({column}), max({column}) from {name}").load().first()
        reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", name)
        if low is not None:
            reader = (reader.option("partitionColumn", column).option("lowerBound", low)
                      .option("upperBound", high).option("numPartitions", partitions))
        tables[name] = conform(reader.load(), TABLES[name])
    return tables


def query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL with bound parameters over the given tables, named in braces in the text."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def live(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("deleted_at").isNull())

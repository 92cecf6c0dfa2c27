"""The request log as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinshelf.schemas import REQUESTS, conform
from kinshelf.session import folders, remove


def append_requests(requests: DataFrame, path: str) -> None:
    """Append request records, one folder per day, so that trailing windows read few files."""
    rows = conform(requests, REQUESTS)
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*REQUESTS.fields, T.StructField("date", T.DateType())])).parquet(path)


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Follow the request log; the schema is given, since a stream does not infer it."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def expire_requests(spark: SparkSession, path: str, first_kept: str) -> list[str]:
    """Retention by time: delete the day folders before ``first_kept`` (``yyyy-MM-dd``); their names.
    No file is read."""
    old = sorted(d for d in folders(spark, path) if d.startswith("date=") and d[5:] < first_kept)
    for day in old:
        remove(spark, f"{path}/{day}")
    return old

"""Session helpers: shared work folder, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, NumericType

from kinshelf.params import BROADCAST_BYTES, BROADCAST_ROWS

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="kinshelf-")
    return _local_dirs[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/kinshelf/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many files as a shuffle has partitions, for short rows that much work follows on."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    store, folder = _folder(spark, path)
    store.delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store; none if it is not there."""
    store, folder = _folder(spark, path)
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def runs_on_workers(module: str) -> None:
    """Send the functions of a module to the Python workers by value, so that executors
    need no installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def pass_count(rows: int, bound: int = BROADCAST_ROWS) -> int:
    """Number of hash passes that keep each pass well under ``bound`` rows."""
    return 1 if rows <= bound else math.ceil(2 * rows / bound)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows and bytes are within the bounds, else as it is.

    What is broadcast passes through the driver, which holds it several times.
    """
    size = F.lit(8 * len(df.columns))
    for field in df.schema:
        if not isinstance(field.dataType, (NumericType, BooleanType)):
            size = size + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= bound and held <= BROADCAST_BYTES else df


def in_pass(df: DataFrame, key: str, n_passes: int, k: int) -> DataFrame:
    if n_passes == 1:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(n_passes)) == k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

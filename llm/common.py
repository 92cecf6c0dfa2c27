"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinshelf.session import materialise, runs_on_workers

__all__ = ["bounded_batches", "bucket", "documents", "held_out", "lean", "materialise", "runs_on_workers", "table", "text_or_empty",
           "word_count", "worker_cache"]

BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most so many rows and bytes, unless the session
    asks for fewer. The settings are the session's and stay: what is built here runs later."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(f"spark.sql.execution.arrow.{name}") or "").rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    """Number of runs of characters that are not blanks; 0 for null."""
    squeezed = F.regexp_replace(F.concat(F.lit(" "), text_or_empty(text), F.lit(" ")), BLANKS, " ")
    return F.length(F.regexp_replace(squeezed, r"[^\x20]", "")).cast("bigint") - 1


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: every fourth by the checksum of the id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def bucket(key: Column, n: int, salt: int = 0) -> Column:
    """Hash bucket of a key: the same for every layout of the data."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that its tasks share it."""
    return _caches().setdefault(name, {})


def _caches() -> dict:
    return sys.modules.setdefault("_kinshelf_worker_cache", types.ModuleType("_kinshelf_worker_cache")).__dict__


def lean(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """A map for Python workers that operators use in turn: it drops what others left in the caches of
    the worker, all but the cache ``keep``, and gives freed memory back to the system at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        for name, cache in _caches().items():
            if name != keep and isinstance(cache, dict) and not name.startswith("__"):
                cache.clear()
        _give_back()
        yield from run(batches)
        _give_back()

    return wrapped


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


runs_on_workers(__name__)

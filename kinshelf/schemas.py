"""Explicit schemas of the source tables; nothing is inferred."""

from pyspark.sql import types as T

_L, _S, _D, _TS, _I, _B = (
    T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.BooleanType(),
)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


BOOKS = _struct(
    id=_L, title=_S, slug=_S, cover_local_path=_S, description=_S,
    average_rating=_D, rating_count=_L, language=_S, deleted_at=_TS, updated_at=_TS,
)
BOOK_AUTHORS = _struct(canonical_book_id=_L, author_id=_L)
BOOK_CATEGORIES = _struct(canonical_book_id=_L, category_id=_L)
NAMED = _struct(id=_L, name=_S, deleted_at=_TS)
REQUESTS = _struct(
    request_id=_L, ts=_TS, duration_ms=_D, status=_S, book_title=_S, recommendations_count=_I,
    cache_hit=_B, error_type=_S, client=_S, user_agent=_S, api_key=_S,
)
HOST_METRICS = _struct(
    host_id=_L, ts=_TS, cpu_percent=_D, memory_percent=_D, memory_mb=_D, disk_usage_percent=_D,
)
CATALOGUE = _struct(
    id=_L, title=_S, slug=_S, cover_local_path=_S, description=_S,
    average_rating=_D, rating_count=_L, authors=_S, categories=_S,
)

TABLES = {
    "books_with_details": BOOKS,
    "book_authors": BOOK_AUTHORS,
    "authors": NAMED,
    "book_categories": BOOK_CATEGORIES,
    "categories": NAMED,
    "requests": REQUESTS,
    "host_metrics": HOST_METRICS,
}


def conform(df, schema: T.StructType):
    """Project ``df`` onto ``schema``; a missing column fails at analysis time."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])

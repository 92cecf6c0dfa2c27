"""The service's tables as views over the given test tables.

The SQL is valid unchanged in Spark and DuckDB. Spark binds the tables in braces to
DataFrames; the check SQL uses the same text with the braces removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinshelf.schemas import TABLES, conform

VIEWS = {
    "books_with_details": """
select d.doc_id as id,
  substring(split_part(d.text,'.',1),1,60) as title,
  case when d.doc_id % 11 = 0 then null else concat('doc-',cast(d.doc_id as varchar(20))) end as slug,
  case when d.doc_id % 13 = 0 then null else concat('covers/',cast(d.doc_id as varchar(20)),'.jpg') end as cover_local_path,
  case when d.doc_id % 97 = 0 then '' when d.doc_id % 101 = 0 then null else d.text end as description,
  cast(case when l.quality is null then null
            else l.quality * 2.5 + 1.0 + (d.doc_id % 5) * 0.25 end as double) as average_rating,
  case when l.quality is null then null else d.n_chars end as rating_count,
  d.lang as language,
  case when d.doc_id % 50 = 49 then timestamp '2024-02-01 00:00:00' else null end as deleted_at,
  timestamp '2024-01-01 00:00:00' + (d.doc_id % 10000) * interval '1' minute as updated_at
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "authors": """
select a as id, concat('Author ',cast(a as varchar(9))) as name,
  case when a = 3 then timestamp '2024-02-01 00:00:00' else null end as deleted_at
from (select distinct doc_id % 4 as a from {documents}) t""",
    "book_authors": """
select doc_id as canonical_book_id, cast(substring(source,4,9) as bigint) % 4 as author_id
from {documents} where doc_id % 17 <> 0
union all
select doc_id, (cast(substring(source,4,9) as bigint) + 1) % 4 from {documents} where doc_id % 3 = 0""",
    "categories": """
select a as id, concat('Category ',cast(a as varchar(9))) as name,
  case when a = 5 then timestamp '2024-02-01 00:00:00' else null end as deleted_at
from (select distinct doc_id % 6 as a from {documents}) t""",
    "book_categories": """
select doc_id as canonical_book_id, doc_id % 6 as category_id from {documents} where doc_id % 19 <> 0
union all
select doc_id, (doc_id + 2) % 6 from {documents} where doc_id % 2 = 0""",
    "requests": """
select event_id as request_id, ts, value as duration_ms,
  case when event_type = 'error' then 'error' else 'success' end as status,
  concat('title ',cast(user_id % 40 as varchar(9))) as book_title,
  cast(event_id % 11 as int) as recommendations_count,
  event_type = 'view' as cache_hit,
  case when event_type <> 'error' then null
       when user_id % 3 = 0 then 'BookNotFoundError'
       when user_id % 3 = 1 then 'RecommendationTimeoutError' else '' end as error_type,
  concat('10.0.0.',cast(user_id as varchar(9))) as client,
  case when user_id % 10 = 0 then 'Googlebot/2.1' when user_id % 10 = 1 then null
       when user_id % 10 = 2 then 'My-Crawler' else 'Mozilla/5.0' end as user_agent,
  case when user_id % 7 = 0 then null when user_id % 7 = 1 then 'short'
       when user_id % 7 = 2 then 'bad key with spaces here!!'
       else concat('key_',substring('abcdefghijklmnopqrstuvwxyz',1,20),cast(user_id as varchar(9))) end as api_key
from {events}""",
    "host_metrics": """
select event_id % 8 as host_id, ts, value / 4 as cpu_percent,
  50 + (event_id % 45) as memory_percent, value * 10 as memory_mb,
  60 + (event_id % 37) as disk_usage_percent
from {events}""",
    # One title request per labelled document; the spelling varies with the id so that every
    # stage of the lookup and every validation rule is met.
    "rec_requests": """
select r.request_id,
  case r.form
    when 0 then case when r.lang = 'en' then upper(r.t) else r.t end
    when 1 then r.t
    when 2 then substring(r.t, 6, 20)
    when 3 then concat(r.t, ' and other stories')
    when 4 then concat('Zzqx 98765 ', cast(r.request_id as varchar(20)))
    when 5 then concat('The Handmaid''s ', r.t)
    when 6 then case when r.request_id % 2 = 0 then null else '   ' end
    when 7 then concat('É', r.t)
    when 11 then repeat('a', 501)
    when 12 then concat(substring(r.t, 1, 10), '  ', substring(r.t, 11, 10))
    else r.t end as title,
  case r.form when 1 then '25' when 2 then '5' when 8 then '101' when 9 then '100'
    when 10 then '1.5' when 3 then ' 7 ' when 7 then null else '10' end as limit_raw,
  case r.form when 0 then '0.3' when 1 then '0.05' when 3 then 'nan' when 9 then '0.0'
    when 12 then '1.5' else null end as threshold_raw,
  r.request_id % 4 <> 0 as include_metadata
from (select d.doc_id as request_id, d.doc_id % 13 as form, d.lang as lang,
        substring(split_part(d.text,'.',1),1,60) as t
      from {labels} l join {documents} d on l.doc_id = d.doc_id) r""",
    # One search per benchmark item: a word, a piece across words, a default label, a name, a blank.
    "search_requests": """
select item_id as request_id,
  case item_id % 6
    when 0 then split_part(text, ' ', 2)
    when 1 then concat(' ', upper(substring(text, 12, 18)), ' ')
    when 2 then 'Unknown'
    when 3 then concat('author ', cast(item_id % 4 as varchar(9)))
    when 4 then substring(text, 9, 5)
    else case when item_id % 4 = 1 then '  ' else substring(text, 3, 2) end end as term,
  cast(case item_id % 5 when 0 then 0 when 1 then 3 when 2 then 25 else 10 end as bigint) as hits
from {benchmark}""",
}
INPUTS = {
    "books_with_details": ("documents", "labels"),
    "authors": ("documents",),
    "book_authors": ("documents",),
    "categories": ("documents",),
    "book_categories": ("documents",),
    "requests": ("events",),
    "host_metrics": ("events",),
    "rec_requests": ("documents", "labels"),
    "search_requests": ("benchmark",),
}
CATALOGUE_TABLES = ("books_with_details", "book_authors", "authors", "book_categories", "categories")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Timestamps are compared as UTC wall-clock values everywhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    inputs = {table: spark.read.parquet(f"{folder}/{table}.parquet") for table in INPUTS[name]}
    df = spark.sql(VIEWS[name], **inputs)
    return conform(df, TABLES[name]) if name in TABLES else df


def views(spark: SparkSession, folder: str, names=CATALOGUE_TABLES) -> dict[str, DataFrame]:
    return {name: view(spark, folder, name) for name in names}


def sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The given tables that the catalogue views are made from."""
    names = sorted({table for view_name in CATALOGUE_TABLES for table in INPUTS[view_name]})
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def part_catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A second catalogue at volume: parts as books, order lines as links.

    Suppliers are authors (a low balance counts as deleted) and the customer's market
    segment is the category.
    """
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    gone = F.lit("2024-02-01 00:00:00").cast("timestamp")
    lines, orders, customers = table("lineitem"), table("orders"), table("customer")
    segments = (
        lines.select("l_partkey", "l_orderkey").distinct()
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("l_partkey").alias("canonical_book_id"), F.col("c_mktsegment").alias("category_id"))
    )
    return {
        "books_with_details": table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("slug"),
            F.lit(None).cast("string").alias("cover_local_path"), F.col("p_type").alias("description"),
            F.col("p_retailprice").alias("average_rating"), F.col("p_size").cast("bigint").alias("rating_count"),
            F.lit("en").alias("language"), F.lit(None).cast("timestamp").alias("deleted_at"),
        ),
        "book_authors": lines.where(F.col("l_linenumber") == 1).select(
            F.col("l_partkey").alias("canonical_book_id"), F.col("l_suppkey").alias("author_id")),
        "authors": table("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") <= 5000, gone).alias("deleted_at")),
        "book_categories": segments,
        "categories": customers.select(F.col("c_mktsegment").alias("id")).distinct().select(
            "id", F.col("id").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at")),
    }

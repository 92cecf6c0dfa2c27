"""The registered queries of this package and the check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import check_sql, language, pii, secrets, toxicity
from llm.collision_search import search_nearest
from llm.common import documents, table
from llm.conversations import damaged_report
from llm.exact_dedup import exact_dedup
from llm.jaccard_join import near_duplicates
from llm.mixing import mix
from llm.packing import pack_documents
from llm.spans import digest_columns
from llm.topk_search import top_k
from llm.vector_codes import code_report, compress
from llm.warc import captures_of, parse_records, resolve_revisits

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.label(docs, language.train(docs)).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), tokenizer_path(), carry={"ids_crc32": F.crc32("ids")})


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return secrets.scan(docs, secrets.learn(docs)).select("doc_id", *digest_columns("spans", secrets.KINDS))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder)).drop("text_key")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, folder)).select("doc_id", *digest_columns("spans", pii.KINDS))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve_revisits(parse_records(captures_of(table(spark, folder, "pages"))))
    head = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "url_key", "outcome", "response_id", head.alias("headers"),
                        F.md5("payload").alias("payload_md5"))


def op10_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return damaged_report(table(spark, folder, "conversations"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, _ = compress(table(spark, folder, "embeddings"))
    return code_report(codes)


def op13_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_exact_dedup, op2_language, op3_packing, op4_secrets, op5_toxicity, op6_jaccard_join, op7_mixing, op8_pii, op9_warc, op10_topk_search,
    op11_conversations, op12_vector_codes, op13_collision_search)}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLES: dict[str, str] = {
    "op12_vector_codes": check_sql.vector_codes(),
    "op1_exact_dedup": f"""
        with t as (select doc_id, sha256({_NORMAL}) as text_sha256, {_NORMAL} as normal from documents),
        g as (select normal, min(doc_id) as keep_id, count(*) as group_size from t group by normal)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (normal)""",
    "op10_topk_search": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
          from embeddings where embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id,
            cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
          from (select distinct vec_id, v from v) q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    "op9_warc": r"""
        with b as (select page_id as p, url, html, md5(coalesce(html, '')) as m,
            regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages),
        u as (select p, html, m,
            regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
            || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
            regexp_replace(regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '(^|&)utm_[^&=]*(=[^&]*)?', '', 'g'), '^&', '') as asked
          from b),
        k as (select p, html, m, base || case when asked <> '' then '?' || asked else '' end as url_key from u),
        r as (
          select p * 5 as id, url_key, p as at, true as is_full, 'a' || m as tag, 0 as turn, html from k
          union all select p * 5 + 1, url_key, p + 1000000, false, 'a' || m, 1, html from k
          union all select p * 5 + 2, url_key, p + 2000000, p % 3 = 0,
            case when p % 3 = 0 then 'b' || m when p % 7 = 0 then 'gone' else 'a' || m end, 2, html from k
          union all select p * 5 + 3, url_key, p - 1000000, false, 'a' || m, 3, html from k
          union all select p * 5 + 4, url_key, p + 3000000, false, 'a' || m, 4, html from k),
        f as (select q.id as record_id, q.url_key, q.tag, q.turn, arg_max(s.id, (s.at, s.id)) as found
          from r q left join r s on s.url_key = q.url_key and s.is_full and s.at < q.at
          where not q.is_full group by all)
        select record_id, f.url_key,
          case when found is null then 'no_response' when s.tag = f.tag then 'resolved' else 'mismatch' end as outcome,
          found as response_id,
          case when s.tag = f.tag then 'content-length=' || length(s.html) || ';etag="' || s.tag || '";x-turn=' || f.turn
            else 'content-length=0;etag="' || f.tag || '";x-turn=' || f.turn end as headers,
          case when s.tag = f.tag then md5(s.html) end as payload_md5
        from f left join r s on s.id = f.found""",
}

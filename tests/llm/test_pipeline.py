"""The pipeline's stages, each on its own input."""

import re

import pytest

import corpus_pipeline
from conftest import SMALL
from llm.common import materialise

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, before, SMALL), name)
        rows = docs.collect()
        sizes.append(len(rows))
        if name != "packing":
            assert docs.columns == NAMES
            held = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(held[r["doc_id"]] == r["text"] for r in rows)
        ids = {r["doc_id"] for r in rows}
        if name == "toxicity":
            clean = [i for i, toxic in labels.items() if not toxic]
            assert sum(i in ids for i in clean) >= 0.97 * len(clean)
        elif name in ("exact_dedup", "jaccard_join"):
            texts = [re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in rows]
            assert len(texts) == len(set(texts)) == len(ids)
        elif name == "packing":
            assert ids == {r["doc_id"] for r in before.collect()}
            assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert all(sizes)


@pytest.mark.parametrize("name", ["exact_dedup", "jaccard_join", "mixing", "packing", "toxicity"])
def test_stages_of_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, None, None, None, None, 1), (1, "", None, "s", 0, 1), (1, "", None, "s", 0, 1), (2, "a b", "en", None, 3, 1),
            (2, "a b", "en", None, 3, 1), (3, "word " * 4000, "en", "s", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int")
    got = stage(spark, docs, SMALL)
    if name != "packing":
        assert got.columns == docs.columns
    assert got.count() > 0
    assert stage(spark, docs.where("false"), SMALL).count() == 0

"""Building the model: catalogue -> text -> TF-IDF -> title index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from kinshelf.functions.titles import author_key, title_key
from kinshelf.operators import tfidf
from kinshelf.operators.gram_index import GramIndex
from kinshelf.operators.lookup import TitleIndex
from kinshelf.operators.search import text_grams
from kinshelf.params import ModelParams
from kinshelf.session import materialise
from kinshelf.sources.catalogue import titles_index


@dataclass
class Model:
    """The tables every job reads.

    ``vectors`` holds one row per book that has a term:
    ``(id, vec, head, title_key, author_key)``. A stored model has gram indexes of its titles and
    of its texts.
    """

    catalogue: DataFrame
    vocab: DataFrame
    vectors: DataFrame
    titles: DataFrame
    params: ModelParams
    title_index: TitleIndex | None = None
    text_index: GramIndex | None = None

    TABLES = ("catalogue", "vocab", "vectors", "titles")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}


def build_indexes(model: Model, path: str) -> Model:
    """Stores the gram indexes under ``path``."""
    TitleIndex.build(model.catalogue, f"{path}/titles")
    text_grams(model.catalogue, f"{path}/texts")
    return with_indexes(model, path)


def with_indexes(model: Model, path: str) -> Model:
    spark = model.catalogue.sparkSession
    return replace(model, title_index=TitleIndex.open(spark, f"{path}/titles"), text_index=GramIndex.open(spark, f"{path}/texts", anchored=False))


def build_model(catalogue: DataFrame, params: ModelParams, write=materialise) -> Model:
    """Build and write each table once. ``write(df, name)`` stores a table and reads it back."""
    catalogue = write(catalogue, "catalogue")
    documents = tfidf.document_terms(catalogue, params)
    vocab = write(tfidf.vocabulary(tfidf.term_stats(documents), catalogue, params), "vocab")
    if vocab.isEmpty():
        raise ValueError("no term passes the document frequency limits: the model is not ready")
    keys = catalogue.select("id", title_key(F.col("title")).alias("title_key"),
                            author_key(F.col("authors")).alias("author_key"))
    vec = tfidf.vectors(documents, vocab, params.max_features).join(keys, "id")
    return Model(catalogue, vocab, write(vec, "vectors"), write(titles_index(catalogue), "titles"), params)

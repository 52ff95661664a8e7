"""Embeddings of entries: models by name, an index of vectors with the model's table beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_frequency, hashed_vectors, tfidf_weights
from ..functions.vectors import vector_search, vector_upsert
from ..sources.tables import load, settle, stage, swap

DIMENSION = 256


@dataclass(frozen=True)
class EmbeddingModel:
    """train gives a model's table from texts(path, text); embed gives (path, vector array<float>) of texts by it."""

    train: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame, DataFrame], DataFrame]


def _tfidf(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """Hashed TF-IDF vectors; a text without terms has the zero vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIMENSION)
    made = hashed_vectors(tfidf_weights(texts, idf, "text"), DIMENSION)
    return texts.select("path").join(made, "path", "left").select("path", F.coalesce("vector", zero).alias("vector"))


EMBEDDING_MODELS: dict[str, EmbeddingModel] = {"tfidf": EmbeddingModel(lambda texts: document_frequency(texts, "text").select("term", "idf"), _tfidf)}


def register_embedding_model(name: str, model: EmbeddingModel) -> None:
    """Makes a model available by name; a name that is taken is replaced."""
    EMBEDDING_MODELS[name] = model


def texts_of(entries: DataFrame) -> DataFrame:
    """(path, text): title and body, as they are embedded; null counts as empty."""
    return entries.select("path", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).alias("text"))


def _indexed(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    return entries.select("path", "title", "domain").join(vectors, "path").select("path", "vector", "title", "domain")


def batch_embed_all(entries: DataFrame, model: str = "tfidf") -> tuple[DataFrame, DataFrame]:
    """(vectors(path, vector, title, domain), the model's table), both staged: trained on all entries, every one embedded."""
    texts, chosen = texts_of(entries), EMBEDDING_MODELS[model]
    table = stage(chosen.train(texts), "model")
    return stage(_indexed(entries, chosen.embed(texts, table)), "vectors"), table


def embed_entry(entries: DataFrame, path: str, vectors: DataFrame, table: DataFrame | None = None, model: str = "tfidf") -> tuple[DataFrame, DataFrame]:
    """(vectors with the entry's put in, the one nearest to it): (path, title, domain, score).

    Without a table the model is trained on all entries.  A path that no entry has changes nothing and has no hit.
    """
    chosen = EMBEDDING_MODELS[model]
    table = stage(chosen.train(texts_of(entries)), "model") if table is None else table
    me = entries.where(F.col("path") == path)
    own = stage(_indexed(me, chosen.embed(texts_of(me), table)), "vector")
    indexed = vector_upsert(vectors, own)
    nearest = vector_search(indexed, own.select(F.col("vector").alias("q")), 1)
    return indexed, nearest.join(indexed.select("path", "title", "domain"), "path").select("path", "title", "domain", "score")


def save_vectors(vectors: DataFrame, table: DataFrame, root: str) -> None:
    """Replaces the vector index below root, its vectors and the model's table together, in one step."""
    fresh = f"{root}/vector_index.new-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{fresh}/vectors")
    table.write.parquet(f"{fresh}/model")
    swap(vectors.sparkSession, fresh, f"{root}/vector_index")


def load_vectors(spark: SparkSession, root: str, rebuild: Callable[[], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, the model's table) as saved; an index that is missing or lacks columns is rebuilt, or raises.

    One that is there but cannot be read raises in any case: it is not trained anew and not overwritten.
    """
    settle(spark, f"{root}/vector_index")
    try:
        vectors = load(spark, f"{root}/vector_index/vectors", required=("path", "vector", "title", "domain"))
        return vectors, load(spark, f"{root}/vector_index/model")
    except (AnalysisException, ValueError) as e:  # what load raises for a missing table, and for one without its columns
        if rebuild is None or isinstance(e, AnalysisException) and e.getCondition() != "PATH_NOT_FOUND":
            raise
    save_vectors(*rebuild(), root)
    return load_vectors(spark, root)

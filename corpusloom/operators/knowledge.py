"""Embedding cache, and versions of a knowledge base: manifests, listing, rollback by pointer."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import UnknownVersion
from corpusloom.functions.text import digest
from corpusloom.sources.commits import CommitLog

MANIFEST = "version_id string, dataset_hash string, document_count long, embedding_model string, embedding_model_hash string, reranker_model string, index_type string, embedding_cache_path string, created_at double"


@dataclass(frozen=True)
class KnowledgeVersion:
    version_id: str
    dataset_hash: str
    document_count: int
    embedding_model: str
    embedding_model_hash: str | None = None
    reranker_model: str | None = None
    index_type: str = "flat-inner-product"
    embedding_cache_path: str | None = None
    created_at: float = 0.0


def new_version(dataset_hash: str, count: int, model: str, **more) -> KnowledgeVersion:
    now = time.time()
    return KnowledgeVersion(f"v{int(now)}", dataset_hash, count, model, created_at=now, **more)


def save_version(spark: SparkSession, version: KnowledgeVersion, root: str) -> None:
    """A manifest of its own folder: versions never overwrite each other."""
    spark.createDataFrame([tuple(asdict(version).values())], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/version_id={version.version_id}")


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifests").orderBy("version_id")


def make_current(spark: SparkSession, root: str, version_id: str) -> None:
    """Roll back or forward: the pointer moves, no version is deleted or copied."""
    if list_versions(spark, root).filter(F.col("version_id") == version_id).isEmpty():
        raise UnknownVersion(f"no version {version_id!r}")
    CommitLog(spark, f"{root}/current").update(lambda version, state: {"version_id": version_id})


def current_version(spark: SparkSession, root: str) -> str:
    """The version the last whole commit of the pointer names; while another one is being written, the one before it."""
    state = CommitLog(spark, f"{root}/current").latest()[1]
    if not state:
        raise UnknownVersion(f"no version of {root!r} was made current")
    return state["version_id"]


def save_artifact(df: DataFrame, root: str, version_id: str, name: str) -> None:
    """A table of one version (vectors, a cache, postings) beside its manifest."""
    df.write.mode("errorifexists").parquet(f"{root}/artifacts/{name}/version_id={version_id}")


def read_artifact(spark: SparkSession, root: str, name: str, version_id: str | None = None) -> DataFrame:
    """That table of a version, by default of the current one: after a roll-back, readers get the older tables."""
    return spark.read.parquet(f"{root}/artifacts/{name}/version_id={version_id or current_version(spark, root)}")


def cache_misses(docs: DataFrame, cache: DataFrame, text: str, key: str) -> DataFrame:
    """key, doc_hash of the texts whose hash is not in the cache, once a hash."""
    hashed = docs.groupBy(digest(F.col(text)).alias("doc_hash")).agg(F.min(key).alias(key))
    return hashed.join(cache.select("doc_hash"), "doc_hash", "left_anti")


def cached_embeddings(docs: DataFrame, cache: DataFrame, encoder, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(every row's embedding, the cache with what was missing): only texts not seen before are encoded."""
    todo = cache_misses(docs, cache, text, key).select(key)
    fresh = docs.join(todo, key, "left_semi").select(digest(F.col(text)).alias("doc_hash"), encoder(F.coalesce(F.col(text), F.lit(""))).alias("embedding")).dropDuplicates(["doc_hash"])
    full = cache.select("doc_hash", "embedding").unionByName(fresh)
    return docs.select(key, digest(F.col(text)).alias("doc_hash")).join(full, "doc_hash", "left").select(key, "embedding"), full


def dataset_hash(docs: DataFrame, order: str, key: str, text: str) -> DataFrame:
    """One row: digest of ids and texts in order, whatever the size of the table."""
    from corpusloom.operators.ingest import tree_digest

    part: Column = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("None")), digest(F.col(text)))
    return tree_digest(docs, order, part)

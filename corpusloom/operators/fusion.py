"""Union of dense and lexical hits, and their fusion with a reranker's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hybrid_union(dense: DataFrame, bm25: DataFrame, limit: int, query: str = "qid", key: str = "document_id") -> DataFrame:
    """query, key, dense_score, bm25_score, pool_rank: dense hits in their order, then the other lexical hits in theirs.

    Inputs: query, key, score, rank. A full outer join, so a document found twice carries both scores.
    """
    d = dense.select(query, key, F.col("score").alias("dense_score"), F.col("rank").alias("_d"))
    b = bm25.select(query, key, F.col("score").alias("bm25_score"), F.col("rank").alias("_b"))
    order = Window.partitionBy(query).orderBy(F.asc_nulls_last("_d"), F.asc("_b"))
    pool = d.join(b, [query, key], "full").withColumn("pool_rank", F.row_number().over(order))
    return pool.filter(F.col("pool_rank") <= limit).drop("_d", "_b")


def fused(pool: DataFrame, top_k: int, alpha: float = 0.75, query: str = "qid", key: str = "document_id", score: str = "reranker_score") -> DataFrame:
    """Add final_score and rank: alpha * position prior + (1 - alpha) * scaled reranker score; ties by key as text.

    Scores are scaled to 0..1 in each pool, all to 0.5 if they are equal; a missing score counts as 0.
    """
    w = Window.partitionBy(query)
    rr = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    low, high, n = F.min(rr).over(w), F.max(rr).over(w), F.count("*").over(w)
    scaled = F.when(high - low < 1e-8, 0.5).otherwise((rr - low) / (high - low))
    prior = 1.0 - (F.col("pool_rank") - 1) / F.greatest(F.lit(1), n - 1)
    out = pool.withColumn("final_score", F.round(alpha * prior + (1 - alpha) * scaled, 6))
    order = Window.partitionBy(query).orderBy(F.desc("final_score"), F.asc(F.col(key).cast("string")))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def unfused(pool: DataFrame, top_k: int) -> DataFrame:
    """Without a reranker the pool's order is the ranking."""
    return pool.filter(F.col("pool_rank") <= top_k).withColumn("rank", F.col("pool_rank"))

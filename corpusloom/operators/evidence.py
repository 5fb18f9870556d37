"""Evidence under a size budget, cited contexts, and the check of citations against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import source_block


def hit_score() -> Column:
    """The reranker's score, else the dense one, else 0; a score of 0 counts as missing."""
    return F.coalesce(F.nullif(F.col("reranker_score").cast("double"), F.lit(0.0)), F.nullif(F.col("dense_score").cast("double"), F.lit(0.0)), F.lit(0.0))


def within_budget(rows: DataFrame, size: Column, limit: int, query: str = "qid", order: str = "rank") -> DataFrame:
    """The leading rows of each query whose sizes sum to at most ``limit``: all rows after the first overflow go too."""
    w = Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used_chars", F.sum(size.cast("long")).over(w)).filter(F.col("used_chars") <= limit)


def select_evidence(hits: DataFrame, max_chars: int = 14_000, min_score: float = 0.0, query: str = "qid") -> DataFrame:
    return within_budget(hits.filter(hit_score() >= min_score), F.length(F.coalesce("text", F.lit(""))), max_chars, query)


def grounded_context(evidence: DataFrame, max_chars: int = 14_000, query: str = "qid") -> DataFrame:
    """query, context, n_sources: numbered source blocks, as many as fit; separators are not counted."""
    order = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    blocks = evidence.withColumn("_n", order).withColumn("_block", source_block(F.col("_n"), F.col("law_name"), F.col("article_id"), F.col("text"), F.col("document_id")))
    kept = within_budget(blocks, F.length("_block"), max_chars, query, "_n")
    listed = F.array_sort(F.collect_list(F.struct("_n", "_block")))
    return kept.groupBy(query).agg(F.array_join(F.transform(listed, lambda s: s["_block"]), "\n\n").alias("context"), F.count("*").alias("n_sources"))


def listed(hits: DataFrame, parts: Column, separator: str, limit: int, name: str, query: str = "qid", order: str = "rank") -> DataFrame:
    """query, ``name``: the first ``limit`` hits of each query, formatted and joined."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(order))).filter(F.col("_n") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("_n", parts.alias("p"))))
    return first.groupBy(query).agg(F.array_join(F.transform(rows, lambda s: s["p"]), separator).alias(name))


def summary_context(hits: DataFrame, query: str = "qid") -> DataFrame:
    return listed(hits, F.concat(F.col("law_name"), F.lit(" / المادة "), F.col("article_id"), F.lit(": "), F.col("text")), "\n\n", 6, "context", query)


def citation_summary(hits: DataFrame, query: str = "qid") -> DataFrame:
    return listed(hits, F.concat(F.col("law_name"), F.lit(" / المادة "), F.col("article_id")), "; ", 3, "citations", query)


def fallback_citations(hits: DataFrame, query: str = "qid") -> DataFrame:
    """The first three hits as citations (law_name, article_id, text)."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy("rank"))).filter("_n <= 3")
    rows = F.array_sort(F.collect_list(F.struct("_n", "law_name", "article_id", "text")))
    return first.groupBy(query).agg(F.transform(rows, lambda s: F.struct(s["law_name"].alias("law_name"), s["article_id"].alias("article_id"), s["text"].alias("text"))).alias("citations"))


def citation_warnings(citations: DataFrame, evidence: DataFrame, query: str = "qid", cited: str = "source_id", key: str = "document_id") -> DataFrame:
    """query, position, warning: one row for each cited id that is not among the query's evidence; blank ids are skipped."""
    asked = citations.filter(F.coalesce(F.col(cited), F.lit("")) != "")
    known = evidence.select(query, F.col(key).cast("string").alias(cited)).distinct()
    lost = asked.join(known, [query, cited], "left_anti")
    return lost.select(query, "position", F.concat(F.lit("Citation id='"), cited, F.lit("' not found in evidence — possible hallucination.")).alias("warning"))

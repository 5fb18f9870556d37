"""Retrieval quality: evaluation sets, reciprocal rank, recall, hit rate, latency summaries, the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import eval_query
from corpusloom.operators.quantiles import exact_quantile

CUTS = (1, 3, 5, 10)
#: Fixed floors: the lexical index on self-retrieval, and the protected hybrid run.
CI_FLOORS = {"mrr": 0.90, "recall_at_1": 0.85, "recall_at_3": 0.92, "recall_at_5": 0.93, "recall_at_10": 0.93}
PROTECTED = {"mrr": 0.835, "recall_at_1": 0.75, "recall_at_3": 0.90, "recall_at_5": 0.95, "recall_at_10": 1.00}


def eval_set(docs: DataFrame, size: int, seed: int, key: str = "document_id", text: str = "raw_text") -> DataFrame:
    """key, query: self-retrieval queries of ``size`` documents, chosen by a seeded hash of the id."""
    out = docs.select(key, eval_query(F.col(text)).alias("query")).filter("query is not null")
    return out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def per_query(hits: DataFrame, relevant: DataFrame, query: str = "qid", key: str = "idx") -> DataFrame:
    """query, rr, recall_at_k, hit_at_k for every query of ``relevant`` (query, key), also those without hits."""
    truth = relevant.select(query, key).distinct()
    return _measures(hits.join(truth, [query, key]), truth.groupBy(query).agg(F.count(key).alias("n_relevant")), query, key)


def per_query_by_label(hits: DataFrame, queries: DataFrame, items: DataFrame, query: str = "qid", key: str = "idx", label: str = "label") -> DataFrame:
    """:func:`per_query` where all items (key, label) that share a label with a query (query, label) are relevant.

    No row is made for a query and its item: items are counted by the set of their labels, queries take the sums of the sets
    that meet theirs, and only hits are looked up.
    """

    def sets(df, name, out):
        return df.filter(F.col(label).isNotNull()).groupBy(name).agg(F.array_sort(F.collect_set(label)).alias(out))

    mine, held = sets(queries, query, "_asked"), sets(items, key, "_held")
    counts = held.groupBy("_held").agg(F.count(key).alias("n"))
    wanted = mine.select("_asked").distinct().withColumn("_label", F.explode("_asked"))
    meet = wanted.join(counts.withColumn("_label", F.explode("_held")), "_label").select("_asked", "_held", "n").distinct()
    total = mine.join(meet.groupBy("_asked").agg(F.sum("n").alias("n_relevant")), "_asked").select(query, "n_relevant")
    good = hits.select(query, key, "rank").join(mine, query).join(held, key).filter(F.arrays_overlap("_asked", "_held"))
    return _measures(good, total, query, key)


def _measures(relevant: DataFrame, total: DataFrame, query: str, key: str) -> DataFrame:
    # a document found twice counts once, at its best rank
    good = relevant.groupBy(query, key).agg(F.min("rank").alias("rank"))
    found = good.groupBy(query).agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in CUTS])
    rows = total.join(found, query, "left")
    recall = [F.when(F.col("n_relevant") > 0, F.coalesce(F.col(f"in_{k}"), F.lit(0)) / F.col("n_relevant")).otherwise(0.0).alias(f"recall_at_{k}") for k in CUTS]
    hit = [F.when(F.coalesce(F.col(f"in_{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}") for k in CUTS]
    return rows.select(query, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), *recall, *hit)


def summary(scores: DataFrame) -> DataFrame:
    """One row of means over queries; 0 without queries."""
    names = {"rr": "mrr", **{f"recall_at_{k}": f"recall_at_{k}" for k in CUTS}, **{f"hit_at_{k}": f"hit_rate_at_{k}" for k in CUTS}}
    return scores.agg(*[F.bround(F.coalesce(F.avg(a), F.lit(0.0)), 6).alias(b) for a, b in names.items()])


def gate(metrics: DataFrame, floors: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """metric, measured, floor, passed, gate_passed: a row a metric; a missing measure fails."""
    spark = metrics.sparkSession
    names = [m for m in floors if m in metrics.columns]
    measured = metrics.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("measured")) for m in names])).alias("s")).select("s.*")
    wanted = spark.createDataFrame(list(floors.items()), "metric string, floor double")
    rows = wanted.join(measured, "metric", "left").withColumn("passed", F.coalesce(F.col("measured") >= F.col("floor") - tolerance, F.lit(False)))
    everything = rows.agg(F.bool_and("passed").alias("ok")).select("ok").scalar()
    return rows.withColumn("gate_passed", everything)


def latency(rows: DataFrame, group: str, ms: str) -> DataFrame:
    """Mean, 95th percentile and throughput (1000 / mean) of each group, of any size."""
    mean = F.avg(ms)
    means = rows.groupBy(F.col(group).alias("g")).agg(F.bround(mean, 6).alias("mean_ms"), F.bround(1000 / mean, 6).alias("per_second"))
    p95 = exact_quantile(rows, group, ms, 0.95)
    joined = means.alias("m").join(p95.alias("q"), F.col("m.g").eqNullSafe(F.col(f"q.{group}")))
    return joined.select(F.col("m.g").alias(group), "mean_ms", F.bround("quantile", 6).alias("p95_ms"), "per_second")


def latency_breakdown(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    """Mean milliseconds of each stage, and its share of the time of all stages; a row each, and one named end_to_end."""
    each = rows.groupBy(F.col(stage).alias("stage")).agg(F.sum(ms).alias("total"), F.avg(ms).alias("mean"))
    whole = each.agg(F.sum("total").alias("total"), F.sum("mean").alias("mean")).select(F.lit("end_to_end").alias("stage"), "total", "mean")
    everything = whole.select("total").scalar()
    return each.unionByName(whole).select("stage", F.bround("mean", 6).alias("mean_ms"), F.bround(F.col("total") / everything, 6).alias("share"))

"""Exact top-k inner products in three phases with a uniform threshold.

Each vector is cut into ``lists`` stretches of components; a stretch gives every candidate a partial score, and the score
of a candidate is the sum over the lists. For a block of queries:

1. every task walks its rows in runs, and takes from each run the k best entries of one local list, the lists in turn; only
   for these the whole scores are resolved. The k-th best of all tasks together is a safe cutoff, since k candidates
   reach it. So this phase multiplies a stretch, not whole vectors;
2. the cutoff is sent to all tasks. A candidate that reaches it has a partial score of at least cutoff / lists in some
   list (else its sum were below), so only entries at or above that uniform threshold are collected;
3. the scores of collected entries are resolved, no others; those at or above the cutoff are ranked, in each task first:
   of many rows that tie at the cutoff, a task passes on k a query.

Scores are integers; products run in float64 while no sum can pass 2^52, else in int64. Queries are handled in blocks of
bounded size, each against all rows and each with its results written, so neither what is sent to tasks nor the plan
grows with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, record_batch, written

FOUND = "query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
RANKED = "query_id long, rank int, vec_id long, score long"
#: Bytes of a block of queries, and scores that a task holds of one list at a time.
BLOCK_BYTES, SCORES = 4 << 20, 1 << 22
EXACT, LONGEST = 2.0**52, 2.0**63


def scaled(vectors: DataFrame, key: str, vec: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) as doubles; rows with a null id or a null or non-finite component are left out."""
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are whole
    x = F.transform(F.col(vec), lambda e: whole(e.cast("double") * scale))
    fine = F.forall(F.col(vec), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(vec).isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))


class Scorer:
    """Partial and whole scores of a batch of rows against the query block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, lists: int):
        self.ids, self.queries = ids, queries
        self.cuts = [c for c in np.array_split(np.arange(queries.shape[1]), lists) if len(c)]
        self.largest = float(np.abs(queries).max(initial=0))

    def rows(self, batch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(1)
        return batch.column(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.queries.shape[1])

    def kind(self, rows: np.ndarray) -> type:
        """The numbers in which products with ``rows`` are exact."""
        most = self.largest * float(np.abs(rows).max(initial=0)) * rows.shape[1]
        if most >= LONGEST:
            raise OverflowError("inner products of these vectors do not fit a long")
        return np.float64 if most < EXACT else np.int64

    def partial(self, rows: np.ndarray, lists: list[int], kind: type) -> list[np.ndarray]:
        """For each of these lists the scores of ``rows`` (down) against all queries (across)."""
        return [rows[:, c].astype(kind, copy=False) @ self.queries[:, c].astype(kind, copy=False).T for c in (self.cuts[i] for i in lists)]

    def resolved(self, rows: np.ndarray, row: np.ndarray, query: np.ndarray, kind: type) -> np.ndarray:
        """Whole scores of some pairs."""
        return np.einsum("ij,ij->i", rows[row].astype(kind, copy=False), self.queries[query].astype(kind, copy=False)).astype(np.int64)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query; higher score first, then the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    keep = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return query[keep], vec[keep], score[keep]


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, lists: int = 4, scale: int = 1024, key: str = "vec_id", vec: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by ``every``, against all rows.

    A query's own id is no candidate. Equal scores: smaller id first. Fewer than k candidates: all of them. Vectors must
    have one length: the commonest one (the longer at a tie); others take no part, like invalid ones. A query id that
    repeats is asked once, with its smallest vector; a candidate id that repeats counts each time. No queries or no rows
    give an empty result. Components so large that a score may not fit a long are an error. Other columns of ``vectors``
    are ignored, whatever their names. ``block``: queries at a time, by default as many as have BLOCK_BYTES.
    """
    rows = written(spark, scaled(vectors, key, vec, scale), "vectors")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], RANKED)
    rows = rows.filter(F.size("v") == length["n"])
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // (block or max(1, BLOCK_BYTES // (8 * max(1, length["n"]))))))
    path, order = new_path(spark, "best"), Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    spark.createDataFrame([], RANKED).write.parquet(path)
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about a block
        if mine:
            found = one_block(spark, rows, np.array([r["vec_id"] for r in mine], np.int64), np.array([r["v"] for r in mine], np.float64), k, lists)
            ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(RANKED).parquet(path)


def one_block(spark: SparkSession, rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, lists: int) -> DataFrame:
    """(query_id, vec_id, score): for each query the k best of every task among those that reach the block's cutoff."""
    order = np.argsort(ids)
    sent = spark.sparkContext.broadcast((ids[order], queries[order]))
    step = max(1, SCORES // len(ids))

    def runs(batches):
        """(scorer, number of the run, ids, vectors) of the task's rows, ``step`` of them at most."""
        scorer, n = Scorer(*sent.value, lists), 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield scorer, n, *scorer.rows(batch.slice(at, step))
                n += 1

    def gather(batches):
        held = (np.empty(0, np.int64),) * 3
        for scorer, n, vec, x in runs(batches):
            kind = scorer.kind(x)
            (p,) = scorer.partial(x, [n % len(scorer.cuts)], kind)
            most = min(k + 1, len(vec))  # one more, for the query's own row
            row = np.argpartition(-p, most - 1, axis=0)[:most].ravel()
            q = np.tile(np.arange(len(scorer.ids)), most)
            other = vec[row] != scorer.ids[q]
            row, q = row[other], q[other]
            held = best(*[np.concatenate(y) for y in zip(held, (q, vec[row], scorer.resolved(x, row, q, kind)))], k)
        yield record_batch(FOUND_ARROW, [sent.value[0][held[0]], held[1], held[2]])

    local = rows.mapInArrow(gather, FOUND)
    ranked = local.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    reach = {r["query_id"]: r["score"] for r in ranked.filter(F.col("n") == k).select("query_id", "score").collect()}  # a row a query
    cutoff = [reach.get(i) for i in ids[order].tolist()]
    safe = spark.sparkContext.broadcast((np.array([-(2**63) if c is None else c for c in cutoff], np.int64), np.array([-np.inf if c is None else c for c in cutoff])))

    def collect(batches):
        whole, near = safe.value
        held = (np.empty(0, np.int64),) * 3
        for scorer, _, vec, x in runs(batches):
            kind, m = scorer.kind(x), len(scorer.cuts)
            # in whole numbers a list's share is rounded down; infinities, where any score will do, stay infinities
            share = np.floor(near / m) if kind is np.float64 else np.where(whole == -(2**63), whole, whole // m)
            parts = scorer.partial(x, list(range(m)), kind)
            enough = np.zeros(parts[0].shape, bool)
            for p in parts:
                enough |= p >= share
            row, q = np.nonzero(enough)
            score = np.zeros(len(row), kind)
            for p in parts:
                score += p[row, q]
            score = score.astype(np.int64)
            fine = (score >= whole[q]) & (vec[row] != scorer.ids[q])
            held = best(*[np.concatenate(y) for y in zip(held, (q[fine], vec[row[fine]], score[fine]))], k)
        yield record_batch(FOUND_ARROW, [sent.value[0][held[0]], held[1], held[2]])

    return rows.mapInArrow(collect, FOUND)

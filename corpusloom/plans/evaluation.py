"""The evaluation chain: an evaluation set cut from the corpus, lexical retrieval of it, its measures, and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import EvaluationError
from corpusloom.functions.text import tokens
from corpusloom.operators import evaluate
from corpusloom.operators.blockmax import blockmax_topk
from corpusloom.operators.keeping import kept
from corpusloom.operators.lexical import build_index


def evaluation_run(docs: DataFrame, size: int, seed: int, key: str = "doc_id", text: str = "text", k: int = 10, floors: dict[str, float] | None = None) -> DataFrame:
    """metric, measured, floor, passed, gate_passed of self-retrieval: each query's only relevant document is its own."""
    asked = evaluate.eval_set(docs, size, seed, key, text).select(F.col(key).alias("qid"), tokens(F.col("query")).alias("words"))
    asked = kept(asked, "evaluation set")  # a few rows that cost a pass over all texts, and are read many times
    if asked.isEmpty():
        raise EvaluationError("no text gives a query to evaluate with")
    index = build_index(docs, key, tokens(F.col(text)), only=asked.select(F.explode("words").alias("term"))).kept()
    hits = blockmax_topk(index, asked, k)
    scores = evaluate.per_query(hits, asked.select("qid", F.col("qid").alias("idx")))
    return evaluate.gate(evaluate.summary(scores), floors or evaluate.CI_FLOORS)

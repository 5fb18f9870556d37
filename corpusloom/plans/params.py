"""All knobs of retrieval in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    dense_candidates: int = 30
    bm25_candidates: int = 10
    rerank_candidates: int = 40
    final_k: int = 5
    rerank_max_chars: int = 3500
    alpha: float = 0.75
    max_context_chars: int = 14_000
    min_score: float = 0.0
    k1: float = 1.5
    b: float = 0.75
    chunk_chars: int = 2000
    profile: str = "ui"
    max_query_chars: int = 8000
    max_top_k: int = 20


TEST = Params(dense_candidates=10, bm25_candidates=5, rerank_candidates=10, final_k=3, max_context_chars=4000)
LOCAL = Params(dense_candidates=30, bm25_candidates=12, rerank_candidates=30)
CLI = Params(rerank_max_chars=4500)

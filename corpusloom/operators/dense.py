"""Exact dense top-k by inner product: queries and vectors meet on a grid of cells, the best entries leave each cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.grid import QUERIES, ROWS, on_grid
from corpusloom.operators.lexical import top

#: Scores held at once.
SCORES = 1 << 21


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int, best: np.ndarray) -> np.ndarray:
    """``best`` (query, id, score), k rows a query in order, with what ``scores`` (rows x queries) adds; ties to smaller ids."""
    n = min(k, len(scores))
    cut = -np.partition(-scores, n - 1, axis=0)[n - 1]  # ties at the cut stay
    have = np.bincount(best[:, 0].astype(np.int64), minlength=scores.shape[1])
    full = np.flatnonzero(have >= k)
    last = np.searchsorted(best[:, 0], full, "right") - 1
    cut[full] = np.maximum(cut[full], best[last, 2])
    row, q = np.nonzero(scores >= cut)
    best = np.concatenate([best, np.stack([q, ids[row], scores[row, q]], 1)])
    best = best[np.lexsort((best[:, 1], -best[:, 2], best[:, 0]))]
    return best[np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0]) < k]


def dense_topk(
    queries: DataFrame, vectors: DataFrame, k: int, query: str = "qid", query_vec: str = "vec", key: str = "idx", vec: str = "vec", block: int = QUERIES, rows: int = ROWS
) -> DataFrame:
    """query, key, score (rounded to 6 places), rank. k is limited by the number of vectors; null vectors take no part.

    Queries and vectors are dealt to cells of about ``block`` queries and ``rows`` vectors. Ids have to be whole numbers
    below 2^53.
    """

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        best = np.empty((0, 3))
        if asked.num_rows and held.num_rows:
            q, x, ids = matrix(asked["v"]).T, matrix(held["v"]), held["idx"].to_numpy().astype(np.float64)
            step = max(k, SCORES // asked.num_rows)
            for at in range(0, len(x), step):
                best = best_rows(np.round(x[at : at + step] @ q, 6), ids[at : at + step], k, best)
        names = asked["q"].to_numpy()[best[:, 0].astype(np.int64)] if len(best) else np.empty(0, np.int64)
        return pa.table({query: names, key: best[:, 1].astype(np.int64), "score": np.ascontiguousarray(best[:, 2])})

    asked = queries.filter(F.col(query_vec).isNotNull()).select(F.col(query).cast("long").alias("q"), F.col(query_vec).alias("v"))
    held = vectors.filter(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.col(vec).alias("v"))
    sizes = (queries.count(), vectors.count())  # without the vectors, which may still have to be made
    found = on_grid(asked, held, "q", "idx", search, f"`{query}` long, `{key}` long, score double", block, rows, sizes)
    return top(found, k, query, (key,))

"""BM25 top-k that skips blocks of documents: the same hits as all scores sorted, without a row for every match.

Postings and the weighted terms of queries meet on a grid of cells. A cell's documents are cut into blocks of BLOCK, of
similar length, and for each term and block the largest impact is known. The sum of these over a query's terms bounds the
score of every document of a block. A query takes the blocks in order of their bounds, keeps its k best documents, and
stops at the first block whose bound is below the k-th score; the documents of other blocks are never scored.
With a cell as one block (``block=None``) every document that shares a term is scored, and still only k leave the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.grid import on_grid
from corpusloom.operators.lexical import K1, B, LexicalIndex, impact, top, weighted_terms

#: Documents of a block; blocks first taken, doubled each time; documents, postings and queries of a cell, about.
BLOCK, FIRST, DOCUMENTS, POSTINGS, QUERIES = 16, 4, 1 << 14, 1 << 18, 1024


class Postings:
    """A cell's postings by term and block, with the largest impact of each."""

    def __init__(self, held: pa.Table, block: int | None):
        terms = held["term"].combine_chunks().dictionary_encode()
        self.vocabulary = terms.dictionary
        term, idx, dl = terms.indices.to_numpy().astype(np.int64), held["idx"].to_numpy(), held["dl"].to_numpy()
        self.ids, first, at = np.unique(idx, return_index=True, return_inverse=True)
        by_length = np.lexsort((self.ids, dl[first]))
        self.ids, place = self.ids[by_length], np.empty(len(by_length), np.int64)
        place[by_length] = np.arange(len(by_length))
        block = min(block or len(self.ids), len(self.ids))
        self.block, self.blocks = block, -(-len(self.ids) // block)
        place = place[at]
        order = np.lexsort((place, term))
        self.place, self.value, term = place[order], held["impact"].to_numpy()[order], term[order]
        group = term * self.blocks + self.place // block
        self.head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.tail = np.append(self.head[1:], len(group))
        self.most = np.maximum.reduceat(self.value, self.head)
        self.of = group[self.head] % self.blocks
        self.start = np.searchsorted(group[self.head] // self.blocks, np.arange(len(self.vocabulary) + 1))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, documents scored) of the k best; ties to smaller ids."""
        groups = stretches(self.start[terms], self.start[terms + 1])
        weight = np.repeat(weights, self.start[terms + 1] - self.start[terms])
        bound = np.bincount(self.of[groups], weights=weight * self.most[groups], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, scores, seen, at, step = np.empty(0, np.int64), np.empty(0), 0, 0, FIRST
        while at < len(order):
            some = order[at : at + step]
            if len(ids) >= k:
                some = some[bound[some] >= scores[k - 1] - 1e-6]  # scores are rounded
                if not len(some):
                    break
            at, step = at + step, 2 * step
            nth = np.full(self.blocks, -1)
            nth[some] = np.arange(len(some))
            mine = np.flatnonzero(nth[self.of[groups]] >= 0)
            low, high = self.head[groups[mine]], self.tail[groups[mine]]
            posts = stretches(low, high)
            spot = self.place[posts]
            local = nth[spot // self.block] * self.block + spot % self.block
            score = np.bincount(local, weights=np.repeat(weight[mine], high - low) * self.value[posts], minlength=len(some) * self.block)
            hit = np.flatnonzero(score)
            seen += len(hit)
            found = self.ids[some[hit // self.block] * self.block + hit % self.block]
            ids, scores = np.concatenate([ids, found]), np.concatenate([scores, np.round(score[hit], 6)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores, seen


def stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` to below its ``high``, one after another."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def blockmax_hits(
    index: LexicalIndex, queries: DataFrame, k: int, query: str = "qid", words: str = "words", k1: float = K1, b: float = B, block: int | None = BLOCK, documents: int = DOCUMENTS
) -> DataFrame:
    """query, idx, score, scored: each cell's k best of every query, and how many documents the cell scored for it."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and held.num_rows:
            posts = Postings(held, block)
            code = pc.index_in(asked["term"].combine_chunks(), value_set=posts.vocabulary)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            code, q, idf = code.fill_null(0).to_numpy().astype(np.int64)[known], asked["q"].to_numpy()[known], asked["idf"].to_numpy()[known]
            order = np.lexsort((code, q))
            code, q, idf = code[order], q[order], idf[order]
            cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, np.int64)
            for low, high in zip(cuts[:-1], cuts[1:]):
                ids, scores, seen = posts.top(code[low:high], idf[low:high], k)
                out.append((np.full(len(ids), q[low]), ids, scores, np.full(len(ids), seen)))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64, np.int64))]
        return pa.table(dict(zip((query, "idx", "score", "scored"), columns)))

    weighted = weighted_terms(index, queries, query, words).select(F.col(query).cast("long").alias("q"), "term", "idf")
    rows = index.postings.select(F.col("idx").cast("long").alias("idx"), "dl", "term", impact(index.stats().select("avgdl").scalar(), k1, b).alias("impact"))
    n, posts = index.sizes()
    each = max(1, min(documents, n * POSTINGS // max(1, posts)))  # a cell's memory is that of its postings
    return on_grid(weighted, rows, "q", "idx", search, f"`{query}` long, idx long, score double, scored long", QUERIES, each, (queries.count(), n))


def blockmax_topk(index: LexicalIndex, queries: DataFrame, k: int, query: str = "qid", words: str = "words", **options) -> DataFrame:
    """query, idx, score, rank: the k best documents of every query, ties to smaller ids, and only those that share a term."""
    return top(blockmax_hits(index, queries, k, query, words, **options).drop("scored"), k, query)

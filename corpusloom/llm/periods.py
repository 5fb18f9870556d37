"""Periodic runs of words: stretches in which words ``p`` apart are identical, found on a harmonic grid.

A run of period p with at least ``exponent`` periods covers two neighbours jp and (j+1)p of the grid of p's multiples. For
every p and j the longest common extensions of these two places forward and backward give the whole stretch around them
that keeps period p. Both are range minima: of the common prefixes between neighbours in the suffix array, and in that of
the reversed words. All grids together have n log n points. A place only asks for its extensions where ``exponent``
multiples in a row hold one word, as they do in any run; texts without such a place need no suffix array.

Stretches that different periods find alike are one run, of the smallest of them (a multiple of the smallest period finds
the same stretch). Documents are handled in groups of about GROUP_WORDS words, each word numbered apart for each document,
so that no extension leaves its document; a longer document is a group of its own, in memory linear in its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import check_kept, cut_by_bytes, free_name, small_batches, utf8

#: Words handled at once, grid points made at once, cells of a block of comparisons.
GROUP_WORDS, POINTS, CELLS = 1 << 18, 1 << 20, 1 << 18
RUN = "start long, length long, period long"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by prefix doubling; only those that still tie are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank, tied, key, k = np.empty(n, np.int64), np.arange(n), ids[order], 0
    while len(tied):
        if k:
            suffix = order[tied]
            then = suffix + k
            key = rank[suffix] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            order[tied], key = suffix[by], key[by]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(tied)))
        rank[order[tied]] = np.repeat(tied[head], size)
        tied = tied[np.repeat(size, size) > 1]
        k = 2 * k or 1
    return order, rank


def agreement(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from ``a`` and from ``b`` on, compared in blocks that grow while they agree."""
    n, out, live, step = len(ids), np.zeros(len(a), np.int64), np.arange(len(a)), 1
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        span = np.arange(step)
        same = (ids[np.minimum(i[:, None] + span, n - 1)] == ids[np.minimum(j[:, None] + span, n - 1)]) & (span < (n - np.maximum(i, j))[:, None])
        run = np.where(same.all(1), step, same.argmin(1))
        out[live] += run
        live = live[run == step]
        step = max(1, min(2 * step, CELLS // max(1, len(live))))
    return out


def common_prefixes(ids: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the one before it in order.

    Only where the words before both differ it is compared (such values sum up to n log n at most); elsewhere it is one
    less than that of the place before.
    """
    at = np.arange(len(ids))
    before = np.full(len(ids), -1)
    before[order[1:]] = order[:-1]
    fresh = (before <= 0) | (at == 0) | (ids[at - 1] != ids[before - 1])
    ask = np.flatnonzero(fresh & (before >= 0))
    reach = at.copy()
    reach[ask] += agreement(ids, ask, before[ask])
    out = np.empty(len(ids), np.int64)
    out[rank] = reach[np.maximum.accumulate(np.where(fresh, at, 0))] - at
    return out


class RangeMin:
    """Minima of any range of ``x``: running minima of blocks from both sides, and a sparse table of whole blocks."""

    WIDTH = 16

    def __init__(self, x: np.ndarray):
        grid = np.concatenate([x, np.full(-len(x) % self.WIDTH, x.max(initial=0))]).astype(np.int64).reshape(-1, self.WIDTH)
        self.flat = grid.ravel()
        self.up = np.minimum.accumulate(grid, 1).ravel()
        self.down = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-w], last[w:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of x[lo..hi], both ends included."""
        first, last = lo // self.WIDTH, hi // self.WIDTH
        out = np.minimum(self.down[lo], self.up[hi])
        inside = np.flatnonzero(first == last)
        if len(inside):
            span = lo[inside, None] + np.arange(self.WIDTH)
            out[inside] = np.where(span <= hi[inside, None], self.flat[np.minimum(span, len(self.flat) - 1)], np.iinfo(np.int64).max).min(1)
        level = np.frexp(np.maximum(last - first - 1, 0))[1] - 1  # of the number of whole blocks between
        for k in np.unique(level[level >= 0]).tolist():
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(out[some], np.minimum(self.table[k][first[some] + 1], self.table[k][last[some] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of two different places, from a suffix array with range minima."""

    def __init__(self, ids: np.ndarray):
        order, self.rank = suffix_array(ids)
        self.minima = RangeMin(common_prefixes(ids, order, self.rank))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.minima.least(np.minimum(x, y) + 1, np.maximum(x, y))


def grid_places(ids: np.ndarray, start: np.ndarray, length: np.ndarray, exponent: int):
    """(document, place, period) of grid points at which ``exponent`` multiples in a row hold one word, in blocks."""
    periods = length // exponent
    doc = np.repeat(np.arange(len(length)), periods)
    p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (length[doc] - 1) // p - exponent + 2
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, "right")))
        for low in range(0, int(points[at]) if stop == at + 1 else 1, POINTS):  # one period may have more points than a block
            n = points[at:stop] if stop > at + 1 else np.minimum(points[at:stop] - low, POINTS)
            row = np.repeat(np.arange(at, stop), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low
            place = start[doc[row]] + j * p[row]
            some = np.flatnonzero(ids[place] == ids[place + p[row]])
            for m in range(2, exponent):
                step = m * p[row[some]]
                some = some[ids[place[some]] == ids[place[some] + step]]
            if len(some):
                yield doc[row[some]], place[some], p[row[some]]
        at = stop


def distinct_runs(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) once a stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def find_runs(ids: np.ndarray, length: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by place in ``ids``: the words of documents of ``length`` words one after
    another, numbered so that no number is in two documents."""
    start = np.cumsum(length) - length
    found = list(grid_places(ids, start, length, exponent))
    if not found:
        return np.empty((0, 3), np.int64)
    # suffix arrays of the documents that have such places, and of no others
    held = np.zeros(len(length), bool)
    for doc, _, _ in found:
        held[doc] = True
    kept = ids[np.repeat(held, length)]
    shift = start - (np.cumsum(np.where(held, length, 0)) - np.where(held, length, 0))
    ahead, back, n = Extensions(kept), Extensions(kept[::-1]), len(kept)
    out = np.empty((0, 3), np.int64)
    for doc, place, p in found:
        a = place - shift[doc]
        b = a + p
        end = b + ahead.forward(a, b)
        left = np.where(a > 0, back.forward(np.minimum(n - a, n - 1), n - b), 0)  # words before a and b
        begin = a - left
        fine = end - begin >= np.maximum(least, exponent * p)
        some = np.stack([begin + shift[doc], end + shift[doc], p], 1)[fine]
        out = distinct_runs(np.concatenate([out, some]))
    return out


class Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def runs_of(texts: list[bytes], exponent: int, least: int) -> list[tuple[list[bytes], np.ndarray]]:
    """(words, runs) of each text; runs are rows (start, length, period) by start, then period."""
    words = [t.split() for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    table = Numbers()
    ids = np.fromiter((table[w] for ws in words for w in ws), np.int64, int(length.sum()))
    ids += np.repeat(np.arange(len(words)), length) * len(table)
    found = find_runs(ids, length, exponent, least)
    start = np.cumsum(length) - length
    doc = np.searchsorted(np.cumsum(length), found[:, 0], "right")
    rows = np.stack([found[:, 0] - start[doc], found[:, 1] - found[:, 0], found[:, 2]], 1)
    by = np.lexsort((rows[:, 2], rows[:, 0], doc))
    rows, cuts = rows[by], np.searchsorted(doc[by], np.arange(len(words) + 1))
    return [(w, rows[cuts[i] : cuts[i + 1]]) for i, w in enumerate(words)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run contains after its first period."""
    if len(runs):
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6, keep: list[str] | None = None) -> DataFrame:
    """key, the columns ``keep``, n_words, runs (array of start, length, period by start, then period), collapsed (binary).

    Words are what ASCII white space divides. A run is a longest stretch of its smallest period with at least ``exponent``
    periods and ``least`` words. ``collapsed`` is the text without the words a run contains after its first period. Null
    and empty texts have no words. Rows that repeat and rows with a null key are handled each on its own, texts of any
    length whole. Columns of ``docs`` that are not in ``keep`` are ignored, whatever their names; a column of ``keep`` with
    the name of a column of the result is an error.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    keep = check_kept(keep, [key, "n_words", "runs", "collapsed"])
    read = free_name("_text", [key, *keep])
    rows = small_batches(docs).select(key, *keep, utf8(text).alias(read))

    def scan(batches):
        for batch in batches:
            for some in cut_by_bytes(batch, batch.num_columns - 1, 6 * GROUP_WORDS):  # six bytes a word, about
                found = runs_of(some.column(some.num_columns - 1).to_pylist(), exponent, least)
                flat = np.concatenate([r for _, r in found])
                ends = np.concatenate([[0], np.cumsum([len(r) for _, r in found])]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"]))
                more = [pa.array([len(w) for w, _ in found], pa.int64()), runs, pa.array([collapsed(w, r) for w, r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *more], names=[*some.schema.names[:-1], "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{kinds}, n_words long, runs array<struct<{RUN.replace(' long', ': long')}>>, collapsed binary")


def longest_run(runs: str = "runs"):
    """The run with the greatest length; ties go to the smaller start, then the smaller period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))

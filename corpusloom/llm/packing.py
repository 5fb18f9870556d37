"""Best-fit packing by exact-complement hashing over lengths.

The plan is made on counts: how many pieces there are of each length, at most ``capacity`` numbers however large the
corpus is. An index keyed by sums says how many single lengths, pairs and triples that are still there add up to each
number; it is kept up, in one vector step, whenever a length's count falls to two, one or none. From the longest length
down, the gap a piece leaves is looked up in it, singles before pairs before triples; a combination that fills the
gap exactly is used as often as the counts allow. Gaps without an exact complement take the longest length that fits,
again and again (best fit). Each step uses up one length, so the plan has a few thousand *patterns* at most, each with a
multiplicity.

Documents meet the plan by rank: the r-th piece of a length takes the r-th place that the patterns have for this length.
Ranks come from exact counts a (writing task, length), so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import record_batch, small_batches, written
from corpusloom.llm.encoding import slices, worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, part long, nth long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())])


def cut_pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every whole text (null: empty) plus ``end_id``. Longer documents than ``capacity`` are cut from
    their end: all pieces but the first have exactly ``capacity`` ids. ``nth`` numbers pieces of a length in a task."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder, part = worker_encoder(tokenizer, spaced), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 1):
                all_ids = [x + end for x in encoder(some.column(1))]
                total = np.array([len(x) // 4 for x in all_ids], np.int64)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (total - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                order = np.argsort(length, kind="stable")
                s = length[order]
                nth = np.empty(len(s), np.int64)
                nth[order] = np.arange(len(s)) - np.searchsorted(s, s) + seen[s]
                seen += np.bincount(length, minlength=capacity + 1)
                ids = [all_ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
                yield record_batch(PIECES_ARROW, [some.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, ids, np.full(len(row), part), nth])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


class Sums:
    """Lengths that are there, and how many pairs and triples of them make each sum up to ``capacity``.

    ``pairs`` and ``triples`` count combinations of different lengths, ``doubles`` (x, x), ``mixed`` (x, x, y) and
    ``cubes`` (x, x, x); a length takes part as often as it is there.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.have, self.size = np.zeros(capacity + 1, np.int64), capacity + 1
        self.one, self.pairs, self.triples, self.doubles, self.mixed, self.cubes = (np.zeros(capacity + 1, np.int64) for _ in range(6))
        for n in np.flatnonzero(counts).tolist():
            self.put(n, int(counts[n]))

    def put(self, n: int, count: int) -> None:
        """From now on there are ``count`` pieces of length ``n``; the index follows where that changes what is possible."""
        old, self.have[n] = int(self.have[n]), count
        for level in range(1, 4) if count > old else range(3, 0, -1):
            if (count >= level) != (old >= level):
                (self._first, self._second, self._third)[level - 1](n, 1 if count > old else -1)

    def _add(self, to: np.ndarray, by: int, what: np.ndarray, sign: int) -> None:
        if by < self.size:
            to[by:] += sign * what[: self.size - by]

    def _first(self, n: int, sign: int) -> None:
        """Length n appears or goes. Before it appears and after it goes, no pair holds it."""
        if sign > 0:
            self._add(self.triples, n, self.pairs, 1)
            self._add(self.pairs, n, self.one, 1)
        self.one[n] = sign > 0
        if sign < 0:
            self._add(self.pairs, n, self.one, -1)
            self._add(self.triples, n, self.pairs, -1)
        self._add(self.mixed, n, self.doubles, sign)

    def _second(self, n: int, sign: int) -> None:
        self.one[n] = 0
        self._add(self.mixed, 2 * n, self.one, sign)
        self.one[n] = 1
        if 2 * n < self.size:
            self.doubles[2 * n] += sign

    def _third(self, n: int, sign: int) -> None:
        if 3 * n < self.size:
            self.cubes[3 * n] += sign

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair with that sum whose longer length is the longest."""
        if not self.pairs[total] + self.doubles[total]:
            return None
        x = np.arange(-(-total // 2), total)
        x = int(x[(self.have[x] > 0) & (self.have[total - x] > (2 * x == total))][-1])
        return x, total - x

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The triple with that sum whose longest length, and then the next, is the longest."""
        if not self.triples[total] + self.mixed[total] + self.cubes[total]:
            return None
        x = np.arange((total - 1) // 3 + 1, total - 1)
        x = x[(self.have[x] > 0) & (self.pairs[total - x] + self.doubles[total - x] > 0)]
        for longest in x[::-1].tolist():
            rest = total - longest
            y = np.arange(-(-rest // 2), min(rest - 1, longest) + 1)
            z = rest - y
            fits = y[(self.have[y] > (y == longest)) & (self.have[z] > (z == y).astype(int) + (z == longest))]
            if len(fits):
                return longest, int(fits[-1]), rest - int(fits[-1])
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are still there and sum to ``gap``; the longest first."""
        return (gap,) if self.have[gap] else self.pair(gap) or self.triple(gap)


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) for ``counts[length]`` pieces of each length. Every piece gets a place."""
    counts = counts.astype(np.int64).copy()
    out = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    sums = Sums(counts, capacity)
    have, length = sums.have, capacity - 1
    while length > 0:
        if not have[length]:
            length -= 1
            continue
        lengths, gap = [], capacity
        fit: tuple[int, ...] | None = (length,)
        while fit:
            for n in fit:
                sums.put(n, int(have[n]) - 1)
            lengths += fit
            gap -= sum(fit)
            if not gap:
                break
            best = np.flatnonzero(have[: gap + 1])
            fit = sums.complement(gap) or ((int(best[-1]),) if len(best) else None)
        kinds, uses = np.unique(lengths, return_counts=True)
        more = int((have[kinds] // uses).min())
        for n, use in zip(kinds.tolist(), uses.tolist()):
            sums.put(n, int(have[n]) - more * use)
        out.append((tuple(lengths), 1 + more))
    return out


class Layout:
    """Where the r-th piece of a length goes: (sequence, offset)."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int):
        first, rows = 0, []
        for lengths, times in patterns:
            offset = 0
            for n in lengths:
                rows.append((n, times, first, offset))
                offset += n
            first += times
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.length, self.times, self.first, self.offset = table.T.copy()
        total = np.cumsum(self.times)
        self.total = total
        self.base = np.concatenate([[0], total])[np.searchsorted(self.length, np.arange(capacity + 2))]
        self.sequences = first

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[length] + rank
        at = np.searchsorted(self.total, place, side="right")
        return self.first[at] + place - (self.total[at] - self.times[at]), self.offset[at]


class Packed:
    """A packed corpus: the written ``pieces`` with their ids, and where each of them goes.

    ``assign`` gives any projection of ``pieces`` its sequence_id and offset; only what is asked for is shuffled.
    """

    def __init__(self, pieces: DataFrame, capacity: int):
        self.pieces, self.capacity = pieces, capacity
        cells = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
        counts = np.zeros(capacity + 1, np.int64)
        for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
            counts[r["length"]] = r["n"]
        self.patterns = plan_patterns(counts, capacity)
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        self.ranks = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def assign(self, pieces: DataFrame | None = None) -> DataFrame:
        """``pieces``, or columns of it with length, part and nth among them, plus sequence_id and offset."""
        pieces = self.pieces if pieces is None else pieces
        layout, kept = Layout(self.patterns, self.capacity), [c for c in pieces.columns if c not in ("part", "nth")]

        def place(batches):
            for batch in batches:
                length, nth, before = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "nth", "before"))
                sequence, offset = layout.places(length, nth + before)
                names = batch.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

        ranked = pieces.join(self.ranks, ["part", "length"]).select(*kept, "nth", "before")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-2])
        return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")

    def sequences(self) -> DataFrame:
        """sequence_id, ids: the packed sequences themselves, at most ``capacity`` ids each."""
        rows = self.assign(self.pieces.select("length", "part", "nth", "ids"))
        parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
        return rows.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, spaced: bool = True, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> Packed:
    """Pack every row of ``docs``.

    A null or empty text is ``end_id`` alone; a text of any length is cut into pieces. Repeated rows are packed each on
    its own; a null key stays null; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return Packed(written(spark, cut_pieces(docs, tokenizer, spaced, end_id, capacity, key, text), "pieces", codec="snappy"), capacity)

"""Benchmark decontamination with spaced seeds.

Words are compared lower-cased, without ASCII marks. A seed hashes the words at the marked positions of a mask and
ignores the others, so a hit survives substituted words in the gaps. Seeds of the benchmark items and of the documents
meet in an equality join; every hit fixes a diagonal, along which item and document are compared word by word, and the
document is contaminated by the item if some stretch of ``span`` words (all of a shorter item) agrees in at least
``similarity`` of its places. MASKS are such that every stretch of 13 words with up to two substitutions holds a seed, and
of 7 to 12 words with as many as ``similarity`` allows; items of five or six words, where that is one, have masks of
their own.

The benchmark's words are sent to all tasks in blocks of items of at most ``BLOCK_SEEDS`` seeds, so what is sent is
bounded; a larger benchmark takes more passes over the documents, and each pass is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import check_kept, cut_by_bytes, forget, free_name, small_batches, written


#: Positions that count, of windows of up to 9 words.
MASKS = ("11111", "110111", "1101011", "111001001")
#: Any five or six words with one substitution hold one of these.
FEW_MASKS = ("1111", "11011", "10111", "11101")
SPAN, SIMILARITY = 13, 0.8
BLOCK_SEEDS, PASSES = 1 << 20, 4
#: Places compared, or hits expanded, at once.
CELLS = 1 << 18
#: Bytes of text looked at together.
TEXT_BYTES = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
MARKS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
BLANKED = bytes.maketrans(MARKS, b" " * len(MARKS))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(BLANKED).split() if text else []


def places(mask: str) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask) if c == "1"])


def masks_of(words: int) -> tuple[str, ...]:
    """The masks for an item of so many words; one too short for any is its own seed."""
    return ("1" * words,) if words < 5 else FEW_MASKS if words < 7 else MASKS


def seeds_of(ids: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every seed of one mask in a row of word numbers; 0 is a word that cannot match, and spoils its seeds."""
    n, at = len(ids) - len(mask) + 1, places(mask)
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    fine = ids[at[0] : at[0] + n] > 0
    for p in at[1:]:
        fine &= ids[p : p + n] > 0
    start = np.flatnonzero(fine)
    h = np.full(len(start), salt, np.uint64)
    for p in at:
        h = (h ^ ids[start + p].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h, start


def seeds(ids: np.ndarray, masks=None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every seed of all ``masks``."""
    found = [seeds_of(ids, mask, k + 1) for k, mask in enumerate(masks or MASKS)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def some_stretch_agrees(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, need: int, least: float) -> bool:
    """Whether on one of the diagonals a stretch of ``need`` words, within both, has ``least`` that agree. Diagonals are taken
    in blocks of CELLS places, and the first match ends it."""
    spots, rows = np.arange(len(item)), max(1, CELLS // len(item))
    for first in range(0, len(diagonals), rows):
        at = diagonals[first : first + rows, None] + spots
        same = (doc[np.clip(at, 0, len(doc) - 1)] == item) & (at >= 0) & (at < len(doc))
        sums = np.zeros((len(at), len(item) + 1), np.int32)
        np.cumsum(same, 1, out=sums[:, 1:])
        begin = at[:, : len(item) - need + 1]
        if ((sums[:, need:] - sums[:, :-need] >= least) & (begin >= 0) & (begin + need <= len(doc))).any():
            return True
    return False


class Benchmark:
    """Words, items and sorted seeds of one block of items. ``items`` are (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        found = [(*seeds(w, masks_of(len(w))), i) for i, w in enumerate(self.words) if len(w)]
        h = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        start = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        item = np.repeat([f[2] for f in found], [len(f[0]) for f in found]) if found else np.empty(0, np.int64)
        order = np.lexsort((start, item, h))
        h, self.start, item = h[order], start[order], item[order]
        # entries of one hash and one item, and the groups of a hash
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])) if len(h) else np.empty(0, np.int64)
        self.group_item, self.group_entry, self.group_size = item[new], new, np.diff(np.append(new, len(h)))
        self.hash, self.first_group = np.unique(h[new], return_index=True)
        self.groups = np.diff(np.append(self.first_group, len(new)))
        self.masks = sorted({masks_of(len(w)) for w in self.words if len(w)})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def matches(self, flat: np.ndarray, ends: np.ndarray, span: int, similarity: float) -> set[tuple[int, int]]:
        """(document, item) pairs; ``flat`` holds all documents' word numbers with one 0 after each.

        A document and an item that repeat themselves hit each other far more often than they have diagonals. Such a pair's
        diagonals are compared as they are; those of other pairs are their hits', expanded in blocks of CELLS. So the work
        for a pair is bounded by its diagonals, and memory by a block.
        """
        out: set[tuple[int, int]] = set()
        if not len(self.hash):
            return out
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - 1 - starts
        lengths = np.array([len(w) for w in self.words])
        for masks in self.masks:
            for k, mask in enumerate(masks):
                self._hits_of(flat, starts, ends, size, lengths, mask, k + 1, span, similarity, out)
        return out

    def _hits_of(self, flat, starts, ends, size, lengths, mask, salt, span, similarity, out) -> None:
        h, at = seeds_of(flat, mask, salt)
        place = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[place] == h)
        if not len(hit):
            return
        spot, place = at[hit], place[hit]
        del h, at, hit
        doc = np.searchsorted(ends, spot, side="right")
        order = np.lexsort((spot, place, doc))
        spot, place, doc = spot[order], place[order], doc[order]
        # places of one seed in one document, each paired with the groups of that seed
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        times, n = np.diff(np.append(new, len(spot))), self.groups[place[new]]
        row = np.repeat(np.arange(len(new)), n)
        group = self.first_group[place[new]][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pair_doc, pair_item = doc[new][row], self.group_item[group]
        weight = times[row] * self.group_size[group]
        pair = pair_doc * len(self.words) + pair_item
        known, of = np.unique(pair, return_inverse=True)
        total = np.bincount(of, weights=weight)
        d, i = known // len(self.words), known % len(self.words)
        heavy = total > size[d] + lengths[i]
        def try_all(d, i, diagonals):
            need = min(span, int(lengths[i]))
            if (d, i) not in out and size[d] >= need and some_stretch_agrees(flat[starts[d] : starts[d] + size[d]], self.words[i], diagonals, need, similarity * need - 1e-9):
                out.add((d, i))

        for x, y in zip(d[heavy].tolist(), i[heavy].tolist()):
            need = min(span, int(lengths[y]))
            try_all(x, y, np.arange(need - lengths[y], size[x] - need + 1))
        rows = np.flatnonzero(~heavy[of])
        if not len(rows):
            return
        share = np.cumsum(weight[rows]) // CELLS
        for some in np.split(rows, np.flatnonzero(np.diff(share)) + 1):
            e = np.repeat(some, weight[some])
            nth = np.arange(len(e)) - np.repeat(np.cumsum(weight[some]) - weight[some], weight[some])
            g = group[e]
            diagonal = spot[new[row[e]] + nth // self.group_size[g]] - self.start[self.group_entry[g] + nth % self.group_size[g]]
            known = np.unique(np.stack([pair_doc[e], pair_item[e], diagonal], 1), axis=0)
            cuts = np.flatnonzero(np.concatenate([[True], (known[1:, :2] != known[:-1, :2]).any(1), [True]])).tolist()
            for low, high in zip(cuts, cuts[1:]):
                d, i, _ = known[low].tolist()
                try_all(d, i, known[low:high, 2] - starts[d])


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, limit: int):
    """Blocks of items with at most ``limit`` seeds (one item more at most), read one after another."""
    block, held = [], 0
    for r in benchmark.select(item, text).filter(F.col(item).isNotNull()).distinct().toLocalIterator():
        w = words_of(r[1])
        if w:
            block.append((r[0], w))
            held += len(MASKS) * len(w)
        if held >= limit:
            yield Benchmark(block)
            block, held = [], 0
    if block:
        yield Benchmark(block)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, similarity: float = SIMILARITY, keep: list[str] | None = None, limit: int = BLOCK_SEEDS) -> DataFrame:
    """key, the columns ``keep`` and items (sorted array of item ids, empty if clean) for every row of ``docs``.

    Null and empty texts are clean; items without words and items with a null id take no part; items of fewer than five
    words must occur whole, and of five to nine with at most one word changed. A word counts as equal without its ASCII
    marks and in any case. Rows of ``docs`` are handled each on its own, also where they repeat or have a null key; items
    that repeat count once. Texts are read whole, however long. Columns of ``docs`` that are not in ``keep`` are ignored,
    whatever their names; a column of ``keep`` that is called items or like ``key`` is an error. After PASSES blocks of
    items the rows are written, so that neither the plan nor what the driver holds grows with the benchmark.
    """
    keep = check_kept(keep, [key, "items"])
    read = text if text in keep else free_name("_text", [key, *keep])
    out = small_batches(docs).select(key, *keep, *([] if text in keep else [F.col(text).alias(read)]), F.array().cast("array<long>").alias("items"))
    sent, before = [], None
    for block in benchmark_blocks(benchmark, item, item_text, limit):
        if len(sent) == PASSES:
            then = written(spark, out, "decontaminated")
            for b in sent:
                b.destroy()
            if before is not None:
                forget(spark, before)
            out, before, sent = then, then, []
        back = {i: w for w, i in block.vocabulary.items()}
        sent.append(spark.sparkContext.broadcast([(int(i), [back[x] for x in w]) for i, w in zip(block.ids, (w.tolist() for w in block.words))]))
        out = one_pass(out, read, sent[-1], span, similarity)
    return out.select(key, *keep, "items")


def one_pass(docs: DataFrame, read: str, sent, span: int, similarity: float) -> DataFrame:
    """``docs`` with the items of one block that each row holds added to its ``items``."""

    def scan(batches):
        bench = Benchmark(sent.value)
        for batch in batches:
            names = batch.schema.names
            for some in cut_by_bytes(batch, names.index(read), TEXT_BYTES):
                rows = [bench.numbers(words_of(t)) for t in some.column(names.index(read)).to_pylist()]
                length = np.array([len(r) + 1 for r in rows], np.int64)
                ends = np.cumsum(length)
                flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
                for r, e in zip(rows, ends.tolist()):
                    flat[e - 1 - len(r) : e - 1] = r
                found: dict[int, set[int]] = {}
                for d, i in bench.matches(flat, ends, span, similarity):
                    found.setdefault(d, set()).add(int(bench.ids[i]))
                old = some.column(names.index("items"))
                if found:
                    old = pa.array([sorted({*(x or []), *found.get(d, ())}) for d, x in enumerate(old.to_pylist())], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([old if n == "items" else c for n, c in zip(names, some.columns)], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(scan, kinds)



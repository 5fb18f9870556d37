"""Substring dedup by seed and extend: winnowed anchors, extended both ways to repeats of at least ``window`` words.

Seeds. Of the hashes of ``anchor`` words inside a window of ``window`` words the smallest (the first of equal ones) is the
window's anchor. It depends on the window's words alone, so equal windows have equal anchors at the same offset, and about one
word in seven is an anchor. Anchors that occur once are dropped by counting; documents are joined on the others.

Extension. An anchor answers for the windows whose anchor it is: those that begin between ``hi`` and ``lo`` words before it.
Occurrences of one anchor that agree over this whole reach, to the left and to the right, form a class. All windows of
a member but the first are then repeats of the first one's, however many members there are, and no pairs are made. Only
the first members of different classes of one anchor may agree over less: they are extended by every division of a window
into words left and right of the anchor, again by equality of what these divisions hold. So whatever is compared is an
equality join or a minimum, combined before it is shuffled, and hot anchors are joins that Spark may split.

Windows found in a row that repeat the same place are one maximal repeat.

Words are hashed to 64 bits by sums over their bytes, many words at once. Windows count as equal if their anchors' hashes and the hashes of the whole reach, two
independent ones of 64 bits, are equal.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import check_kept, cut_by_bytes, forget, free_name, record_batch, small_batches, utf8, written

#: Words of a window and of an anchor; bytes of text handled at once, and hashed at once; bytes of a long word.
WINDOW, ANCHOR, TEXT_BYTES, BLOCK_BYTES, LONG_WORD = 20, 8, 1 << 20, 1 << 20, 256
#: Odd bases: of bytes in words, of words in anchors, of words in what these answer for.
BASES = (0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ONE = np.uint64(1)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[2]))


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.known = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            self.known = []
            for base in self.bases:
                row = np.full(n, base, np.uint64)
                row[0] = ONE
                self.known.append(np.cumprod(row))
        return self.known[0][:n], self.known[1][:n]


class Sums:
    """Hashes of any stretch of words by prefix sums of words' hashes times powers of an odd base, modulo 2^64."""

    def __init__(self, h: np.ndarray, powers: Powers):
        power, self.back = powers.upto(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        """Hashes of all stretches of ``length`` words."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])


class Hasher:
    """64-bit hashes of words, many at once, from sums over their bytes; words of more than LONG_WORD bytes one by one. Holds
    the powers of all bases."""

    def __init__(self):
        self.bytes, *self.powers = (Powers(b) for b in BASES)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words a text, hashes of all words one after another); ASCII white space divides words."""
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        first, hashes, at = [], [], 0
        while at < len(raw):
            stop = min(at + BLOCK_BYTES, len(raw))
            while stop < len(raw) and not BLANK[raw[stop]]:  # a block ends between words
                ahead = BLANK[raw[stop : stop + 4096]]
                stop += int(ahead.argmax()) if ahead.any() else len(ahead)
            some = raw[at:stop]
            edge = np.diff(np.concatenate([[True], BLANK[some], [True]]).astype(np.int8))
            begin, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
            power, back = self.bytes.upto(len(some) + 1)
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(OF_BYTE[some] * power[:-1], out=sums[1:])
            h = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
            for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
                h[i] = xxhash.xxh3_64_intdigest(some[begin[i] : end[i]].tobytes())
            first.append(begin + at)
            hashes.append(h)
            at = stop
        ends = np.cumsum([len(t) + 1 for t in texts])
        count = np.searchsorted(np.concatenate(first), ends) if first else np.zeros(len(texts), np.int64)
        return np.diff(count, prepend=0), np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


class Words:
    """Texts cut into words, one text after another; ``anchors`` are the places of anchors, each with its reach."""

    def __init__(self, texts: list[bytes], window: int, anchor: int, hasher: Hasher):
        self.window, self.anchor, self.hasher = window, anchor, hasher
        self.length, self.h = hasher.of(texts)
        self.start = np.cumsum(self.length) - self.length
        h, self.seed = self.h, Sums(self.h, hasher.powers[0])
        ends = np.repeat(self.start + self.length, self.length)
        first = np.flatnonzero(np.arange(len(h)) + window <= ends)  # where windows begin
        if not len(first):
            self.place = self.low = self.high = self.hash = np.empty(0, np.int64)
            self.doc = self.place
            return
        g = self.seed.all(anchor)
        least, w, m = np.arange(len(g)), 1, window - anchor + 1
        while 2 * w <= m:
            a, b = least[:-w], least[w:]
            least = np.where(g[a] <= g[b], a, b)
            w *= 2
        a, b = least[first], least[first + m - w]
        place = np.where(g[a] <= g[b], a, b)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(new[1:], len(place)) - 1
        self.place = place[new]
        self.high, self.low = self.place - first[new], self.place - first[last]
        self.hash = g[self.place].view(np.int64)
        self.doc = np.searchsorted(self.start + self.length, self.place, "right")

    @cached_property
    def whole(self) -> Sums:
        """Sums of a second hash of each word, for what anchors answer for."""
        return Sums(mixed(self.h ^ np.uint64(BASES[2])), self.hasher.powers[1])

    def reach(self, some: np.ndarray) -> np.ndarray:
        """Hash of all the words an anchor answers for."""
        start = self.place[some] - self.high[some]
        return self.whole.of(start, self.high[some] - self.low[some] + self.window).view(np.int64)


def scanned(docs: DataFrame, window: int, anchor: int, schema: pa.Schema, kinds: str, rows) -> DataFrame:
    """``rows(batch, words)`` of each piece of ``docs``, whose last column holds the texts."""

    def scan(batches):
        hasher = Hasher()
        for batch in batches:
            for some in cut_by_bytes(batch, batch.num_columns - 1, TEXT_BYTES):
                yield record_batch(schema, rows(some, Words(some.column(some.num_columns - 1).to_pylist(), window, anchor, hasher)))

    return small_batches(docs).mapInArrow(scan, kinds)


def listed(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(fields of an array of structs of longs, or the longs themselves; where each row's begin and end)."""
    flat = column.values
    fields = [flat.field(i) for i in range(flat.type.num_fields)] if pa.types.is_struct(flat.type) else [flat]
    return [f.to_numpy(zero_copy_only=False) for f in fields], column.offsets.to_numpy()


def anchor_counts(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    def rows(batch, words):
        return list(np.unique(words.hash, return_counts=True))

    parts = scanned(texts, window, anchor, pa.schema([("a", pa.int64()), ("n", pa.int64())]), "a long, n long", rows)
    return parts.groupBy("a").agg(F.sum("n").alias("n"))


def anchors_by_document(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    def rows(batch, words):
        pairs = np.unique(np.stack([words.doc, words.hash], 1), axis=0)
        return [batch.column(0).to_numpy()[pairs[:, 0]], pairs[:, 1]]

    return scanned(texts, window, anchor, pa.schema([("doc", pa.int64()), ("a", pa.int64())]), "doc long, a long", rows)


OCCURRENCES = "a long, c long, low int, high int, doc long, row long, place long"
OCCURRENCES_ARROW = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64()), ("row", pa.int64()), ("place", pa.int64())])
WINDOWS = "a long, o int, c long, doc long, row long, first long"
WINDOWS_ARROW = pa.schema([("a", pa.int64()), ("o", pa.int32()), ("c", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("first", pa.int64())])


def occurrences(texts: DataFrame, shared: DataFrame, window: int, anchor: int) -> DataFrame:
    """All occurrences of anchors that are in the document's list in ``shared`` (doc, list), with the hash of their reach."""

    def rows(batch, words):
        (keys,), cuts = listed(batch.column(2))
        docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(words.place), bool)
        borders = np.searchsorted(words.doc, np.arange(batch.num_rows + 1))
        for i in range(batch.num_rows):
            mine = slice(borders[i], borders[i + 1])
            keep[mine] = np.isin(words.hash[mine], keys[cuts[i] : cuts[i + 1]])
        some = np.flatnonzero(keep)
        d = words.doc[some]
        return [words.hash[some], words.reach(some), words.low[some].astype(np.int32), words.high[some].astype(np.int32), docs[d], hashes[d], words.place[some] - words.start[d]]

    return scanned(texts.join(shared, "doc").select("doc", "row", "list", "text"), window, anchor, OCCURRENCES_ARROW, OCCURRENCES, rows)


def windows_of_first(texts: DataFrame, reps: DataFrame, window: int, anchor: int) -> DataFrame:
    """Every window of the first members ``reps`` (doc, list of row, place, low, high), by anchor, offset and hash."""

    def rows(batch, words):
        (row, place, low, high), cuts = listed(batch.column(2))
        docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
        row, place, low, high = (x[cuts[0] : cuts[-1]] for x in (row, place, low, high))
        mine = np.flatnonzero(row == hashes[at])
        at, place, low, high = at[mine], place[mine], low[mine], high[mine]
        times = high - low + 1
        of = np.repeat(np.arange(len(at)), times)
        o = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times))
        spot = words.start[at[of]] + place[of]
        key, whole = words.seed.of(spot, anchor).view(np.int64), words.whole.of(spot - o, window).view(np.int64)
        return [key, o.astype(np.int32), whole, docs[at[of]], hashes[at[of]], place[of] - o]

    return scanned(texts.join(reps, "doc").select("doc", "row", "list", "text"), window, anchor, WINDOWS_ARROW, WINDOWS, rows)


def finished(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``table``, written by now. Spark deletes the shuffle files of plans that the driver's JVM has collected; texts go through
    three shuffles here, which need not lie on the disks together, so the JVM is asked to collect."""
    spark._jvm.System.gc()
    return table


def row_of(text: str):
    """40 bits that tell texts of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(utf8(text)), 24)


def repeated_windows(spark: SparkSession, docs: DataFrame, key: str, text: str, window: int, anchor: int) -> DataFrame:
    """(doc, row, first, last, from_doc, from_first): windows from ``first`` to ``last`` of a document whose words also begin
    earlier, and where; ``row`` is :func:`row_of` the text. Tables are deleted as soon as nothing reads them."""
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), row_of(text).alias("row"), utf8(text).alias("text"))
    narrow = texts.select("doc", "text")
    again = anchor_counts(narrow, window, anchor).filter("n > 1").select("a")
    shared = anchors_by_document(narrow, window, anchor).join(again, "a").groupBy("doc").agg(F.collect_list("a").alias("list"))
    shared = finished(spark, written(spark, shared, "substring-shared", narrow=True))
    seen = finished(spark, written(spark, occurrences(texts, shared, window, anchor), "substring-seen", narrow=True))
    forget(spark, shared)

    own = F.struct("doc", "row", "place")
    classes = finished(spark, written(spark, seen.groupBy("a", "c", "low", "high").agg(F.min(own).alias("f"), F.count("*").alias("n")), "substring-classes", narrow=True))
    members = seen.join(classes.filter("n > 1").drop("n"), ["a", "c", "low", "high"]).filter(own > F.col("f"))
    covered = members.select("doc", "row", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last"), F.col("f.doc").alias("from_doc"), (F.col("f.place") - F.col("high")).alias("from_first"))
    covered = finished(spark, written(spark, covered, "substring-covered", narrow=True))
    forget(spark, seen)

    several = classes.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    reps = classes.drop("n").join(several, "a").select("f.doc", F.struct(F.col("f.row").alias("row"), F.col("f.place").alias("place"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).alias("r"))
    reps = finished(spark, written(spark, reps.groupBy("doc").agg(F.collect_list("r").alias("list")), "substring-reps", narrow=True))
    forget(spark, classes)
    windows = finished(spark, written(spark, windows_of_first(texts, reps, window, anchor), "substring-windows", narrow=True))
    forget(spark, reps)
    own = F.struct("doc", "row", "first")
    firsts = windows.groupBy("a", "o", "c").agg(F.min(own).alias("f"), F.count("*").alias("n")).filter("n > 1").drop("n")
    partly = windows.join(firsts, ["a", "o", "c"]).filter(own > F.col("f"))
    partly = partly.select("doc", "row", "first", F.col("first").alias("last"), F.col("f.doc").alias("from_doc"), F.col("f.first").alias("from_first"))
    partly = finished(spark, written(spark, partly, "substring-partly", narrow=True))
    forget(spark, windows)
    return covered.unionByName(partly)


def maximal(first: np.ndarray, last: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Rows (start, end, from_doc, from_start): stretches of windows that repeat one place in one document."""
    order = np.lexsort((first, at - first, doc))
    first, last, doc, at = first[order], last[order], doc[order], at[order]
    reach = np.ones(len(first), bool)  # a window range that does not go on from the one before it
    reach[1:] = (doc[1:] != doc[:-1]) | ((at - first)[1:] != (at - first)[:-1]) | (first[1:] > last[:-1] + 1)
    head = np.flatnonzero(reach)
    end = np.maximum.reduceat(last, head) + window if len(head) else last
    rows = np.stack([first[head], end, doc[head], at[head]], 1)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def remove_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, keep: list[str] | None = None) -> DataFrame:
    """key, the columns ``keep``, n_words, n_removed, kept (binary), repeats for every row of ``docs``.

    Words are what ASCII white space divides. A word goes if it is in a window of ``window`` words whose words also begin
    earlier: in a row with a smaller key, or earlier in the same row. ``kept`` are the other words joined by blanks;
    ``repeats`` has the maximal repeats found (start, end, from_id, from_start, in words, end exclusive), each against the
    earliest place of its windows. Windows are judged on the texts as they are, not on what is left of them.

    Null and empty texts have no words. Rows that repeat a key are ordered by a hash of their texts; those with equal texts
    count once, so none of them loses words to another. A row with a null key has no place in the order: it keeps all its
    words and takes none from others. Texts are read whole, however long. Columns of ``docs`` that are not in ``keep`` are
    ignored, whatever their names; a column of ``keep`` with the name of a column of the result is an error.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has at least one word, and no more than a window")
    keep = check_kept(keep, [key, "n_words", "n_removed", "kept", "repeats"])
    found = repeated_windows(spark, docs, key, text, window, anchor)
    ident, row, ranges, read = (free_name(n, [key, *keep]) for n in ("_doc", "_row", "_ranges", "_text"))
    gone = found.groupBy(F.col("doc").alias(ident)).agg(F.collect_list(F.struct("row", "first", "last", "from_doc", "from_first")).alias(ranges))
    cut = small_batches(docs).select(key, *keep, F.col(key).cast("long").alias(ident), row_of(text).alias(row), utf8(text).alias(read))
    none = F.lit(None).cast(gone.schema[ranges].dataType)
    known = cut.filter(F.col(ident).isNotNull()).join(gone, ident, "left").select(key, *keep, row, ranges, read)
    rows = known.unionByName(cut.filter(F.col(ident).isNull()).select(key, *keep, row, none.alias(ranges), read))
    n = 1 + len(keep)
    kind = pa.struct([(f, pa.int64()) for f in ("start", "end", "from_id", "from_start")])

    def scan(batches):
        for batch in batches:
            hashes, lists = batch.column(n).to_numpy(), batch.column(n + 1)
            fields, cuts = listed(lists)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            words_of, removed, kept, repeats, ends = [], [], [], [], [0]
            for i, raw in enumerate(batch.column(n + 2).to_pylist()):
                words, lost = raw.split(), 0
                if valid[i]:
                    own, first, last, doc, at = (f[cuts[i] : cuts[i + 1]] for f in fields)
                    mine = own == hashes[i]
                    first, last, doc, at = first[mine], last[mine], doc[mine], at[mine]
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, last + window, -1)
                    stay = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                    lost = len(words) - len(stay)
                    repeats.append(maximal(first, last, doc, at, window))
                    raw = b" ".join([words[j] for j in stay])
                else:
                    raw = b" ".join(words)
                    repeats.append(np.empty((0, 4), np.int64))
                words_of.append(len(words))
                removed.append(lost)
                kept.append(raw)
                ends.append(ends[-1] + len(repeats[-1]))
            flat = np.concatenate(repeats) if repeats else np.empty((0, 4), np.int64)
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k]), pa.int64()) for k in range(4)], fields=list(kind)))
            more = [pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *more], names=[*batch.schema.names[:n], "n_words", "n_removed", "kept", "repeats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(scan, f"{kinds}, n_words long, n_removed long, kept binary, repeats array<struct<start: long, end: long, from_id: long, from_start: long>>")

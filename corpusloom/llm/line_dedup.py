"""Reversible line dedup: exact reference counts, with a cuckoo filter in front of each shard of shared keys.

State, all written as tables in the shared folder:

* ``refs``   (k1, k2, doc_id): one row for each row and key it holds, the exact reference table;
* ``shared`` (k1, k2, refs, first_doc): its counts, of keys that two or more documents hold;
* ``filters`` (shard, filter): one cuckoo filter a shard, holding the shared keys and nothing else.

``insert`` and ``delete`` write what changes: new refs or deleted ids, the keys these touch and their new counts, and
the filters with the keys taken in or out whose count crossed two. So deleting documents gives their lines back to
the documents that remain. Refs and counts are read through the changes, and written anew after ``COMPACT`` of them. Tables
are never changed in place, and those of earlier states stay until ``vacuum``: a plan made before a change gives the
rows of its own state whenever it runs.

The number of shards follows the number of shared keys, so a filter stays small, and nothing is sent to all tasks: refs
meet the filter of their shard in a cogroup, a shard with many refs in several cells of bounded size, each with a copy of
the filter. Most refs are in no filter and go no further; the others meet the exact counts in a join.

A key is the line's bytes stripped of ASCII white space, ASCII-lower-cased, as a 128-bit hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import check_kept, forget, free_name, record_batch, small_batches, utf8, written
from corpusloom.llm.cuckoo import CuckooFilter

#: Shared keys of a filter, refs of a cell that meets it, changes after which the state is written anew.
KEYS_PER_SHARD, REFS_PER_CELL, COMPACT = 1 << 14, 1 << 16, 8
PAIRS = "k1 long, k2 long, doc_id long"
PAIRS_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])


def long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode()) >= least)


def digests(text: bytes, least: int) -> list[bytes | None]:
    """The 16-byte key of each line, None for keys that are too short to count."""
    h = xxhash.xxh3_128_digest
    return [h(k) if long_enough(k, least) else None for k in (line.strip().lower() for line in text.split(b"\n"))]


def line_refs(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id): each key once for each row that holds it. Rows with a null id hold none."""

    def scan(batches):
        for batch in batches:
            ids, found, times = batch.column(0).to_numpy(zero_copy_only=False), [], []
            for raw in batch.column(1).to_pylist():
                keys = set(digests(raw, least))
                keys.discard(None)
                found.extend(keys)
                times.append(len(keys))
            flat = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield record_batch(PAIRS_ARROW, [np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]), np.repeat(ids, times)])

    known = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).filter("doc_id IS NOT NULL")
    return small_batches(known).mapInArrow(scan, PAIRS)


def shared_keys(refs: DataFrame) -> DataFrame:
    """(k1, k2, refs, first_doc) of keys in two or more documents; rows that repeat a doc_id are one document."""
    counts = refs.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return counts.filter("first_doc < last_doc").drop("last_doc")


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    def build(key, pdf):
        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.build(pdf["k2"].to_numpy(np.int64)).to_bytes()]})

    return shared.select(shard_of(shards), "k2").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def shard_of(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int").alias("shard")


class LineIndex:
    """The state above, for one corpus. ``least`` is the smallest key length in code points."""

    def __init__(self, spark: SparkSession, least: int = 10):
        self.spark, self.least = spark, least
        self.refs: DataFrame | None = None
        self.shared: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards, self.size, self.changes = 1, 0, 0
        self.tables: list[DataFrame] = []  # what refs and shared are read from
        self.retired: list[DataFrame] = []  # what only plans of earlier states read

    def insert(self, docs: DataFrame) -> None:
        """Take in the rows of ``docs``. Rows with a null id are left out."""
        fresh = written(self.spark, line_refs(docs, self.least), "line-refs", narrow=True)
        self.tables.append(fresh)
        if self.refs is not None:
            return self._change(self.refs.unionByName(fresh), fresh.select("k1", "k2").distinct())
        self.refs, self.shared = fresh, written(self.spark, shared_keys(fresh), "line-shared", narrow=True)
        self.tables.append(self.shared)
        self.size = self.shared.count()
        self.shards = max(1, -(-self.size // KEYS_PER_SHARD))
        self.filters = written(self.spark, build_filters(self.shared, self.shards), "line-filters", narrow=True)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out the documents in ``doc_ids`` (column doc_id); their lines then belong to the next smallest document."""
        gone = written(self.spark, doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "line-gone", narrow=True)
        self.tables.append(gone)
        touched = self.refs.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct()
        self._change(self.refs.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), touched)

    def _change(self, refs: DataFrame, touched: DataFrame) -> None:
        """Count the touched keys again, and move the keys that became or ceased to be shared."""
        touched = written(self.spark, touched, "line-touched", narrow=True)
        again = written(self.spark, shared_keys(refs.join(touched, ["k1", "k2"], "left_semi")), "line-again", narrow=True)
        before = self.shared.join(touched, ["k1", "k2"], "left_semi")
        new = again.join(before, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(1).alias("sign"))
        old = before.join(again, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(-1).alias("sign"))
        moves = written(self.spark, new.unionByName(old), "line-moves", narrow=True)
        shared = self.shared.join(touched, ["k1", "k2"], "left_anti").unionByName(again)
        self.tables += [touched, again]
        self.size += moves.agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
        if self.size > self.shards * KEYS_PER_SHARD:
            self.shards = 2 * -(-self.size // KEYS_PER_SHARD)
            filters = written(self.spark, build_filters(shared, self.shards), "line-filters", narrow=True)
        else:
            filters = self._moved(moves, shared)
        forget(self.spark, moves)
        self.retired.append(self.filters)
        self.refs, self.shared, self.filters, self.changes = refs, shared, filters, self.changes + 1
        if self.changes % COMPACT == 0:
            self._compact()

    def _compact(self) -> None:
        self.retired += self.tables
        self.refs, self.shared = written(self.spark, self.refs, "line-refs", narrow=True), written(self.spark, self.shared, "line-shared", narrow=True)
        self.tables = [self.refs, self.shared]

    def vacuum(self) -> None:
        """Delete the tables of earlier states; to be called when no plan made before the last change is still to run."""
        forget(self.spark, *self.retired)
        self.retired = []

    def close(self) -> None:
        """Delete all tables. No plan made from this index can run afterwards, and it takes no more changes."""
        self.vacuum()
        forget(self.spark, *self.tables, *([self.filters] if self.filters is not None else []))
        self.tables, self.refs, self.shared, self.filters = [], None, None, None

    def _moved(self, moves: DataFrame, shared: DataFrame) -> DataFrame:
        """Filters after deletions (sign -1) and insertions (sign 1); a shard that gets too full is built anew."""

        def change(key, pdf, old):
            have = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(1)
            have.delete(pdf["k2"][pdf["sign"] < 0].to_numpy(np.int64))
            add = pdf["k2"][pdf["sign"] > 0].to_numpy(np.int64)
            fits = have.count + len(add) <= 0.84 * have.table.size and have.insert(add)
            return pd.DataFrame({"shard": [key[0]], "filter": [have.to_bytes() if fits else b""]})

        cells = moves.select(shard_of(self.shards), "k2", "sign").groupBy("shard").cogroup(self.filters.groupBy("shard"))
        changed = written(self.spark, cells.applyInPandas(change, "shard int, filter binary"), "line-moved", narrow=True)
        full = changed.filter(F.length("filter") == 0).select("shard")
        anew = shared.select("k1", "k2", shard_of(self.shards)).join(full, "shard", "left_semi")
        out = written(self.spark, changed.filter(F.length("filter") > 0).unionByName(build_filters(anew, self.shards)), "line-filters", narrow=True)
        forget(self.spark, changed)
        return out

    def candidates(self) -> DataFrame:
        """refs whose key some filter knows: all shared ones, and few others."""
        rows = self.refs.select(shard_of(self.shards), "k1", "k2", "doc_id")
        cells = rows.groupBy("shard").agg(F.ceil(F.count("*") / REFS_PER_CELL).cast("int").alias("cells"))  # a row a shard
        rows = rows.join(cells, "shard").withColumn("cell", F.pmod(F.xxhash64("k2", "doc_id"), F.col("cells")).cast("int")).drop("cells")
        copies = self.filters.join(cells, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "filter")

        def probe(refs, known):
            if not known.num_rows:
                return refs.schema.empty_table().select(PAIRS_ARROW.names)
            found = CuckooFilter.from_bytes(known["filter"][0].as_py()).contains(refs["k2"].to_numpy())
            return refs.select(PAIRS_ARROW.names).filter(pa.array(found))

        return rows.groupBy("shard", "cell").cogroup(copies.groupBy("shard", "cell")).applyInArrow(probe, PAIRS)

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses, as pairs of numbers."""
        lost = self.candidates().join(self.shared.select("k1", "k2", "first_doc"), ["k1", "k2"]).filter("doc_id > first_doc")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def strip_shared_lines(index: LineIndex, docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, the columns ``keep``, n_lines, n_dropped, kept: the text without the lines the index takes from it.

    Every row of ``docs`` gives one row; null and empty texts are one empty line. Rows that repeat a doc_id are one
    document: all of them keep the lines whose smallest holder it is, and lose the same others. A row with a null id has
    no place among the holders of a line: it keeps all its lines and takes none from others. A document without lines left
    has an empty text. Texts are handled one at a time, however long they are. Columns of ``docs`` that are not in ``keep``
    are ignored, whatever their names; a column of ``keep`` with the name of a column of the result is an error.
    """
    least, keep = index.least, check_kept(keep, ["doc_id", "n_lines", "n_dropped", "kept"])
    raw_text, lost_keys, ident, salt = (free_name(n, keep) for n in ("_text", "_keys", "_id", "_salt"))
    known = F.col(key).isNotNull()
    spread = F.when(known, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)  # null ids meet nothing, and not in one task
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), *keep, utf8(text).alias(raw_text), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias(ident), spread.alias(salt))
    gone = index.drops().select(F.col("doc_id").alias(ident), F.lit(0).cast("long").alias(salt), F.col("keys").alias(lost_keys))
    joined = rows.join(gone, [ident, salt], "left").select("doc_id", *keep, raw_text, lost_keys)

    def strip(batches):
        for batch in batches:
            kept, lines, dropped = [], [], []
            lists, texts = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            k1, k2 = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            flat = np.ascontiguousarray(np.stack([k1, k2], 1).astype("<i8")).view("V16").ravel()
            ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            for i, raw in enumerate(texts.to_pylist()):
                n, lost = raw.count(b"\n") + 1, 0
                if valid[i]:
                    gone = {x.tobytes() for x in flat[ends[i] : ends[i + 1]]}
                    stay = [line for line, k in zip(raw.split(b"\n"), digests(raw, least)) if k not in gone]
                    raw, lost = b"\n".join(stay), n - len(stay)
                kept.append(raw)
                lines.append(n)
                dropped.append(lost)
            more = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *more], names=[*batch.schema.names[:-2], "n_lines", "n_dropped", "kept"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return joined.mapInArrow(strip, f"{kinds}, n_lines long, n_dropped long, kept binary")

"""Byte-balanced sharding by histogram sort.

Every row gets a place in one total order: hash of the text, then id, then a row number that only orders
rows equal in both. Splitters of that order are found by counting, not by sampling: each round counts the exact bytes
and rows between candidate boundaries on all partitions, and narrows the interval around every splitter to the keys
that really lie in it, until the bytes below the splitter are within tolerance. Then the rows are exchanged once.

Equal texts are neighbours in this order, so they share a shard unless a splitter falls between them; a hot text with
a third of all rows is split like any other stretch. Shards are cut into pieces of equal row counts, found the same way, so
that slots come from many small windows and not from one task per shard; a shard of very many rows without text has as
many pieces as its rows ask for.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import record_batch, tasks_for, written

KEY_BYTES = 24
SPACE = 1 << (8 * KEY_BYTES)
SIGN = np.uint64(1 << 63)
#: Rows of a piece, which one window numbers.
PIECE_ROWS = 1 << 22
GAPS = pa.schema([("gap", pa.int64()), ("size", pa.int64()), ("rows", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])
PLACED = "doc_id long, size long, text_crc32 long, _h long, _id long, _row long"


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """24-byte big-endian sort keys (hash, id, row), so that numpy compares them as byte strings."""
    out = np.empty((batch.num_rows, 3), dtype=">u8")
    for i, name in enumerate(("_h", "_id", "_row")):
        out[:, i] = batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64) ^ SIGN
    return np.ascontiguousarray(out).view(f"S{KEY_BYTES}").ravel()


def _pack(bounds: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(b.to_bytes(KEY_BYTES, "big") for b in bounds), dtype=f"S{KEY_BYTES}")


def _as_int(raw: bytes) -> int:
    return int.from_bytes(bytes(raw).ljust(KEY_BYTES, b"\0"), "big")


def count_between(keyed: DataFrame, bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """Exact (bytes, rows, smallest key, largest key) of each of the len(bounds) + 1 gaps."""
    probes, n = _pack(bounds), len(bounds) + 1

    def count(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = [None] * n, [None] * n
        for batch in batches:
            keys = _keys(batch)
            at = np.searchsorted(probes, keys, side="right")
            size += np.bincount(at, weights=batch.column("size").to_numpy(), minlength=n).astype(np.int64)
            rows += np.bincount(at, minlength=n)
            order = np.argsort(keys, kind="stable")
            spots, first = np.unique(at[order], return_index=True)
            last = np.append(first[1:], len(order)) - 1
            for g, a, b in zip(spots, keys[order[first]], keys[order[last]]):
                a, b = bytes(a).ljust(KEY_BYTES, b"\0"), bytes(b).ljust(KEY_BYTES, b"\0")
                low[g] = a if low[g] is None else min(low[g], a)
                high[g] = b if high[g] is None else max(high[g], b)
        some = np.flatnonzero(rows)
        yield record_batch(GAPS, [some, size[some], rows[some], [low[g] for g in some], [high[g] for g in some]])

    parts = keyed.mapInArrow(count, "gap long, size long, rows long, low binary, high binary")
    out = [(0, 0, 0, 0)] * n
    for r in parts.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r["gap"]] = (r["size"], r["rows"], _as_int(r["low"]), _as_int(r["high"]))
    return out


def find_boundaries(keyed: DataFrame, goals: list[float], allowed: float, by: int, probes: int = 24) -> list[tuple[int, int]]:
    """(boundary, exact rows below it) for each of ``goals``, ascending: so many bytes (``by`` 0) or rows (1) below it.

    A boundary is settled when it is ``allowed`` from its goal at most, or when one row or key is left between its bounds.
    """
    known: dict[int, int] = {0: 0}
    wanted = {b: (0, SPACE - 1) for b in range(len(goals))}
    found: dict[int, int] = {}
    tries = {SPACE * i // (4 * len(goals) + 4) for i in range(1, 4 * len(goals) + 4)}
    while wanted:
        tries |= {min(SPACE - 1, lo + (hi - lo) * (i + 1) // (probes + 1)) for lo, hi in set(wanted.values()) for i in range(probes)} | {b for pair in wanted.values() for b in pair}
        bounds, tries = sorted(b for b in tries if b > 0), set()
        gaps = count_between(keyed, bounds)
        below = np.cumsum([g[by] for g in gaps])
        below, total = below[:-1].tolist(), int(below[-1])
        known.update(zip(bounds, np.cumsum([g[1] for g in gaps])[:-1].tolist()))
        for b in list(wanted):
            i = bisect_right(below, goals[b]) - 1  # the last boundary with at most the goal below it
            left = (bounds[i], below[i]) if i >= 0 else (0, 0)
            right = (bounds[i + 1], below[i + 1]) if i + 1 < len(bounds) else (SPACE - 1, total)
            near = min((left, right), key=lambda x: abs(x[1] - goals[b]))  # noqa: B023
            _, inside, low, high = gaps[i + 1]
            if abs(near[1] - goals[b]) <= allowed or inside <= 1 or low == high:
                found[b] = (left if near[0] == SPACE - 1 and near[0] not in known else near)[0]
                del wanted[b]
            else:
                wanted[b] = (low, min(SPACE - 1, high))
    cuts = np.maximum.accumulate([found[b] for b in range(len(goals))]).tolist() if goals else []
    return [(c, known[c]) for c in cuts]


def ranges_of(spark: SparkSession, keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(boundaries, shard of each range, exact rows of its shard before it): shards near-equal in bytes, cut into pieces of
    near-equal rows."""
    size, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    narrow = keyed.select("_h", "_id", "_row", "size")
    edges = find_boundaries(narrow, [size * b / shards for b in range(1, shards)], tolerance * size / shards, 0)
    below = [0, *[r for _, r in edges], rows]
    piece = -(-rows // tasks_for(spark, rows, PIECE_ROWS)) or 1
    goals, owner = [], []
    for s in range(shards):
        here = below[s + 1] - below[s]
        pieces = max(1, -(-here // piece))
        goals += [below[s] + here * k / pieces for k in range(1, pieces)]
        owner += [s] * (pieces - 1)
    cuts = find_boundaries(narrow, goals, piece / 4, 1)
    # a piece's boundary lies in its shard: rows below it are between those below the shard's own boundaries
    all_cuts = sorted([(c, s + 1, r) for s, (c, r) in enumerate(edges)] + [(c, s, r) for s, (c, r) in zip(owner, cuts)], key=lambda x: (x[0], x[1]))
    shard = np.array([0, *[s for _, s, _ in all_cuts]], np.int64)
    base = np.array([0, *[r for _, _, r in all_cuts]], np.int64) - np.array(below, np.int64)[shard]
    return [c for c, _, _ in all_cuts], shard, base


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = 0.002) -> DataFrame:
    """All rows of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 1; a null or empty text has size 1 and crc32 0. Shards differ in bytes by the
    tolerance or one row, so a very long text may make its shard larger. Repeated rows and rows equal in text each keep
    a place of their own. Rows with a null key stay null and take the places of the smallest possible key. An empty
    table gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("_h"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keyed = written(spark, narrow, "shard-keys", narrow=True)
    cuts, shard, base = ranges_of(spark, keyed, shards, tolerance)
    probes = _pack(cuts)

    def place(batches):  # ids pass through untouched, null or not
        for batch in batches:
            at = np.searchsorted(probes, _keys(batch), side="right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(base[at]), pa.array(shard[at])], names=[*batch.schema.names, "_range", "_base", "_shard"])

    placed = keyed.mapInArrow(place, f"{PLACED}, _range long, _base long, _shard long")
    order = Window.partitionBy("_range").orderBy("_h", "_id", "_row")
    dealt = placed.repartition(len(cuts) + 1, "_range")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_base") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


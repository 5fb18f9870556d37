"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` differing bits are linked. The 64 bits are cut into m partitions, correlated bits
together, and partition i gets a threshold t_i >= -1 with sum(t_i + 1) = radius + 1. If two fingerprints differ in
at most ``radius`` bits, then some partition differs in at most t_i bits; so it is enough to look, for every partition
with t_i >= 0, at fingerprints whose bits there are within t_i, and to verify those. m and the thresholds are chosen by
dynamic programming on the candidates they would cost, estimated from all fingerprints.

Equal fingerprints are one node before anything is compared. A look-up cell (partition, bits) holds the fingerprints that
own these bits and those that come near them. Cells are streamed, sorted, through tasks that emit links that span dense
groups, never all their pairs: once a fingerprint has joined such a group in a cell it is not compared with it again. A
cell with far more owners than others is cut into blocks of owners by blocks of all, so that no task gets all of it.

Where similarity of texts is checked as well (``least``), equal shingle sets are one node, and near fingerprints are
candidates only: a short signature of minwise hashes decides clear cases, the whole sets the others. Bands of minwise
hashes give the similar pairs whose fingerprints are further apart. Cells of bands with the same members count once.
In a cell, members meet with their whole sets; a walk joins what reaches ``least`` and emits a link for each member that
joins, so groups of any density give fewer links than members, all of them exact. A cell too large for a task is cut into
parts; afterwards, where links have not connected all its members, its parts are compared with each other as well.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, record_batch, shuffle_width, small_batches, tasks_for, utf8, written
from corpusloom.llm.components import components

#: Owners of a look-up cell before it is cut, and rows of cells that one task takes, about.
CELL, CELL_ROWS = 1 << 12, 1 << 22
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Bands of minwise hashes, and hashes of each. Sets of similarity 0.8 share a band with a probability of 0.99998.
BANDS, ROWS = 36, 6
#: Bytes of a signature, one of a minwise hash each. It rejects a pair DOUBT below the similarity asked for (5.6 standard
#: deviations at 0.8) and accepts one SURE above it.
SIGNATURE, DOUBT, SURE = 128, 0.2, 0.15
#: Members of a part of a band's cell, and distinct shingles of all of them together.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that stand for the orders of minwise hashes.
TURNS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Nanoseconds of a row that is sent to a cell, and of a comparison in it, as measured.
SIGNATURE_COST, CANDIDATE_COST = 2000.0, 1.5


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of all ``words``-word shingles in order, repeats included; a text without words has none."""
    tokens = text.lower().split()
    flat, n = b" ".join(tokens), len(tokens)
    if n <= words:
        raw = xxhash.xxh64_digest(flat, 42) if n else b""
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
        h = xxhash.xxh64_digest
        count = n - words + 1
        starts = [0, *ends[: count - 1].tolist()]
        raw = b"".join([h(flat[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])
    return np.frombuffer(raw, ">u8")


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes; none of them give 0."""
    if not len(hashes):
        return 0
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = np.einsum("jv,vb->jb", np.bincount(places.ravel(), minlength=2048).reshape(8, 256), BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, words: int) -> int:
    return simhash(shingles(text, words))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes in order; all texts without words share one set."""
    return np.unique(hashes.astype(np.uint64)) if len(hashes) else np.zeros(1, np.uint64)


def set_name(some: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(some.tobytes(), 42), "big", signed=True)


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint 0. ``sets``: also node, a hash of the shingle
    set, and its size, signature and bands."""
    fields = [("doc_id", pa.int64()), ("fp", pa.int64())] + ([("node", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))] if sets else [])
    schema = pa.schema(fields)

    def scan(batches):
        for batch in batches:
            fps, names, sizes, marks, cells = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, words)
                fps.append(simhash(h))
                if sets:
                    some = shingle_set(h)
                    low = minwise(some)
                    names.append(set_name(some))
                    sizes.append(len(some))
                    marks.append(signature(low))
                    cells.append(bands(low))
            yield record_batch(schema, [batch.column(0), fps, *([names, sizes, marks, cells] if sets else [])])

    kinds = "doc_id long, fp long" + (", node long, size long, sig binary, bands array<long>" if sets else "")
    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(scan, kinds)


def minwise(some: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minwise hashes of a shingle set."""
    low = np.full(len(TURNS), 2**64 - 1, np.uint64)
    for at in range(0, len(some), 512):
        np.minimum(low, (TURNS[:, None] * some[None, at : at + 512]).min(1), out=low)
    return low


def signature(low: np.ndarray) -> bytes:
    return (low[:SIGNATURE] * MIX >> np.uint64(56)).astype(np.uint8).tobytes()


def bands(low: np.ndarray) -> np.ndarray:
    """BANDS cells, each of ROWS minwise hashes. Sets of Jaccard similarity s share one with probability
    1 - (1 - s^ROWS)^BANDS, whatever their size."""
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ column) * MIX
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def limits(least: float) -> tuple[int, int]:
    """Equal bytes of two signatures below which a pair is rejected, and from which on it is accepted."""
    equal = lambda s: SIGNATURE * (s + (1 - s) / 256)  # noqa: E731  other hashes have equal bytes once in 256
    return math.floor(equal(least - DOUBT)), math.ceil(equal(min(1.0, least + SURE)))


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp.astype(">i8")).view(np.uint8).reshape(-1, 8), axis=1)


def correlation(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, 64 x 64 absolute bit correlations) over all of them."""

    def scan(batches):
        n, both = 0, np.zeros((64, 64))
        for pdf in batches:
            b = bits_of(pdf["fp"].to_numpy(np.int64)).astype(np.float32)
            n, both = n + len(b), both + b.T @ b
        yield pd.DataFrame({"i": np.arange(4097), "n": np.append(both.ravel(), n).round().astype(np.int64)})

    rows = nodes.select("fp").mapInPandas(scan, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r["i"]] = r["n"]
    n, both = int(flat[-1]), flat[:-1].reshape(64, 64)
    if not n:
        return 0, np.zeros((64, 64))
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(c, 0)
    return n, c


def grouped_bits(c: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of nearly equal size; the most correlated bits join the same group first."""
    room = -(-64 // parts)
    group = {i: [i] for i in range(64)}
    for a, b in sorted(combinations(range(64), 2), key=lambda x: -c[x]):
        if group[a] is not group[b] and len(group[a]) + len(group[b]) <= room and c[a, b] > 0.02:
            group[a].extend(group[b])
            for i in group[b]:
                group[i] = group[a]
    bins: list[list[int]] = [[] for _ in range(parts)]
    free = [64 // parts + (i < 64 % parts) for i in range(parts)]
    for g in sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True):
        left = list(g)
        while left:  # what a bin has no room for goes to the next emptiest
            i = max(range(parts), key=free.__getitem__)
            take, left = left[: free[i]], left[free[i] :]
            bins[i] += take
            free[i] -= len(take)
    return bins


def masks(bins: list[list[int]]) -> list[int]:
    return [sum(1 << (63 - b) for b in g) for g in bins]


def distances(nodes: DataFrame, plans: list[list[int]]) -> list[list[np.ndarray]]:
    """For each plan and partition, how often two fingerprints differ in d bits there: every fingerprint is paired with
    a few others of its task, so the estimate follows all data at linear cost."""
    flat = [(p, i, m) for p, ms in enumerate(plans) for i, m in enumerate(ms)]

    def scan(batches):
        total = np.zeros((len(flat), 65), np.int64)
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(fp * np.uint64(0x9E3779B97F4A7C15))
            fp = fp[order]
            for shift in (1, 2, 3, 5):
                if len(fp) > shift:
                    x = fp[shift:] ^ fp[:-shift]
                    for k, (_, _, m) in enumerate(flat):
                        total[k] += np.bincount(np.bitwise_count(x & np.uint64(m)), minlength=65)
        yield pd.DataFrame({"k": np.repeat(np.arange(len(flat)), 65), "d": np.tile(np.arange(65), len(flat)), "n": total.ravel()})

    got = np.zeros((len(flat), 65))
    for r in nodes.select("fp").mapInPandas(scan, "k int, d int, n long").groupBy("k", "d").agg(F.sum("n").alias("n")).collect():
        got[r["k"], r["d"]] = r["n"]
    out: list[list[np.ndarray]] = [[] for _ in plans]
    for k, (p, _, m) in enumerate(flat):
        w = m.bit_count()
        prior = np.array([np.prod([(w - i) / (i + 1) for i in range(d)]) for d in range(65)]) / 2.0**w  # a random partition
        out[p].append((got[k] + prior) / (got[k].sum() + 1))
    return out


def ball(width: int, t: int) -> int:
    n, c = 0, 1
    for d in range(t + 1):
        n, c = n + c, c * (width - d) // (d + 1)
    return n


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 and the least total of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, radius + 1 - used):
                if t + 1 < len(row):
                    x = (cost + row[t + 1], [*ts, t])
                    if used + t + 1 not in new or x[0] < new[used + t + 1][0]:
                        new[used + t + 1] = x
        best = new
    return best[radius + 1]


def choose(nodes: DataFrame, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is looked up."""
    n, c = correlation(nodes)
    plans = [masks(grouped_bits(c, m)) for m in range(2, radius + 2)] or [masks([list(range(64))])]
    found = []
    for ms, hist in zip(plans, distances(nodes, plans)):
        costs = []
        for m, h in zip(ms, hist):
            w, row = m.bit_count(), [0.0]
            for t in range(min(radius, 4, w) + 1):
                row.append(SIGNATURE_COST * n * (ball(w, t) + 1) + CANDIDATE_COST * n * n * float(h[: t + 1].sum()))
            costs.append(row)
        try:
            found.append((*allocate(costs, radius), ms))
        except KeyError:
            continue
    _, ts, ms = min(found)
    return [(m, t) for m, t in zip(ms, ts) if t >= 0]


def signatures(nodes: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(part, bits, node, fp, own): for each partition its bits, and all bits within the threshold."""
    flips = []
    for m, t in plan:
        bit = [np.uint64(1 << b) for b in range(64) if m >> b & 1]
        flips.append(np.array([np.bitwise_or.reduce(x) if x else np.uint64(0) for d in range(t + 1) for x in combinations(bit, d)], np.uint64))
    schema = pa.schema([("part", pa.int8()), ("bits", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                node, fp = (some.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for part, ((m, _), flip) in enumerate(zip(plan, flips)):
                    bits = ((fp.view(np.uint64) & np.uint64(m))[:, None] ^ flip[None, :]).ravel().view(np.int64)
                    own = np.tile(np.arange(len(flip)) == 0, len(fp))
                    yield record_batch(schema, [np.full(len(bits), part, np.int8), bits, np.repeat(node, len(flip)), np.repeat(fp, len(flip)), own])

    return nodes.select("node", "fp").mapInArrow(scan, "part byte, bits long, node long, fp long, own boolean")


def cell_links(fp: np.ndarray, own: np.ndarray, radius: int, small: int = 1 << 14, rows: int = 32, many: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions in a cell that connect everything that owners link to.

    Owners are compared, some at a time, with all that is left of the cell, and then leave it. If one of them has many
    links, its whole component is walked instead: what has joined it leaves the cell at once and is never compared with it
    again, so a cell of near copies costs about linear time and gives links that span it, not all pairs.
    """
    a = np.flatnonzero(own)
    if len(a) * len(fp) <= small:
        i, j = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[None, :]) <= radius)
        keep = (a[i] < j) | ~own[j]
        return a[i][keep], j[keep]
    left, out_i, out_j = np.ones(len(fp), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(a := a[left[a]]):
        block, rest = a[:rows], np.flatnonzero(left)
        near = np.bitwise_count(fp[block][:, None] ^ fp[rest][None, :]) <= radius
        near[np.arange(len(block)), np.searchsorted(rest, block)] = False
        count = near.sum(1)
        if count.max() <= many:
            i, j = np.nonzero(near)
            out_i.append(block[i])
            out_j.append(rest[j])
            left[block] = False
            continue
        front = block[[count.argmax()]]
        left[front] = False
        while len(front):
            some, front = front[:rows], front[rows:]
            for mine, among in ((some[own[some]], left), (some[~own[some]], left & own)):
                among = np.flatnonzero(among)
                if len(mine) and len(among):
                    near = np.bitwise_count(fp[mine][:, None] ^ fp[among][None, :]) <= radius
                    hit = near.any(0)
                    got = among[hit]
                    out_i.append(mine[near[:, hit].argmax(0)])
                    out_j.append(got)
                    left[got] = False
                    front = np.concatenate([front, got])
    return np.concatenate(out_i), np.concatenate(out_j)


def links(nodes: DataFrame, plan: list[tuple[int, int]], radius: int, width: int, cell: int = CELL) -> DataFrame:
    """(a, b): links between nodes that connect the same components as all pairs within ``radius``."""
    rows = signatures(nodes, plan)
    usual = F.array(*[F.lit(4.0 * 0.5 ** m.bit_count()) for m, _ in plan])  # four times a part's mean share of the nodes
    most = F.greatest(F.lit(cell), nodes.agg(F.count("*").alias("n")).select("n").scalar() * usual[F.col("part").cast("int")])
    own = signatures(nodes, [(m, 0) for m, _ in plan]).groupBy("part", "bits").agg(F.count("*").alias("n"))
    large = own.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).filter("blocks > 1").select("part", "bits", "blocks")
    rows = rows.join(large, ["part", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, all_blocks = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), F.lit(own).alias("own"))
    as_owner = F.transform(all_blocks, lambda j: place(mine, j, True))
    as_other = lambda blocks: F.transform(blocks, lambda i: place(i, mine, False))
    # an owner meets all blocks as an owner; to owners of earlier blocks it is one of the others
    spots = F.when(F.col("own"), F.concat(as_owner, as_other(F.filter(all_blocks, lambda i: i < mine)))).otherwise(as_other(all_blocks))
    rows = rows.select("part", "bits", "node", "fp", F.explode(spots).alias("s")).select("part", "bits", F.struct("s.i", "s.j").alias("at"), "node", "fp", "s.own")
    rows = rows.select("part", "bits", (F.col("at.i").cast("long") * F.lit(1 << 31) + F.col("at.j")).alias("copy"), "node", "fp", "own")
    cells = rows.repartition(width, "part", "bits", "copy").sortWithinPartitions("part", "bits", "copy")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(batches):
        held: list[np.ndarray] | None = None

        def work(columns, last):
            """Links of all whole cells; the last cell stays for the next batch."""
            part, bits, copy, node, fp, own = columns
            change = np.flatnonzero((part[1:] != part[:-1]) | (bits[1:] != bits[:-1]) | (copy[1:] != copy[:-1])) + 1
            edges = np.concatenate([[0], change, [len(part)]])
            whole = len(edges) - 1 if last else len(edges) - 2
            size = np.diff(edges[: whole + 1])
            owners = np.concatenate([[0], np.cumsum(own)])
            owned = owners[edges[1 : whole + 1]] - owners[edges[:whole]]
            out_a, out_b = [], []
            for k in np.flatnonzero((size > 1) & (owned > 0)).tolist():
                x, y = edges[k], edges[k + 1]
                i, j = cell_links(fp[x:y], own[x:y], radius)
                if len(i):
                    out_a.append(node[x + i])
                    out_b.append(node[x + j])
            rest = [c[edges[whole] :] for c in columns]
            if not out_a:
                return None, rest
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
            return record_batch(schema, [pairs[:, 0].copy(), pairs[:, 1].copy()]), rest

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns[4] = columns[4].view(np.uint64)
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            found, held = work(held, False)
            if found is not None:
                yield found
        if held is not None and len(held[0]):
            found, _ = work(held, True)
            if found is not None:
                yield found

    return cells.mapInArrow(scan, "a long, b long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


PAIR = "a long, b long, clear boolean"
PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("clear", pa.bool_())])
LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def plausible(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, clear) of the links whose signatures leave the similarity possible."""
    reject, accept = limits(least)
    sigs = lambda name, as_name: nodes.select(F.col("node").alias(name), F.col("sig").alias(as_name))
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def scan(batches):
        for batch in batches:
            n = np.count_nonzero(signatures_of(batch.column(2)) == signatures_of(batch.column(3)), axis=1)
            keep = n >= reject
            yield record_batch(PAIR_ARROW, [batch.column(0), batch.column(1), n >= accept]).filter(pa.array(keep))

    return pairs.join(sigs("a", "x"), "a").join(sigs("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(scan, PAIR)


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(node, set): the whole shingle sets of the nodes in ``wanted``, drawn again from the texts."""
    touched = wanted.distinct().join(nodes.select("node", "first"), "node").select(F.col("first").alias("_id"), "node")
    rows = docs.select(F.col(key).cast("long").alias("_id"), utf8(text).alias("_text")).join(touched, "_id").select("node", "_text")  # a repeated doc_id has texts of other nodes as well
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def draw(batches):
        for batch in batches:
            sets = [shingle_set(shingles(t, words)) for t in batch.column(1).to_pylist()]
            mine = [set_name(x) == n for x, n in zip(sets, batch.column(0).to_pylist())]
            yield record_batch(schema, [batch.column(0), [x.tobytes() for x in sets]]).filter(pa.array(mine, pa.bool_()))

    drawn = rows.mapInArrow(draw, "node long, set binary").groupBy("node").agg(F.max("set").alias("set"))
    return written(docs.sparkSession, drawn, "sets", narrow=True)


def judged(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, clear) that are clear, or whose sets have at least ``least`` in common."""

    def judge(batches):
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            fine = [similarity(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) >= least for u, v in both]
            yield record_batch(LINK_ARROW, batch.columns[:2]).filter(pa.array(fine, pa.bool_()))

    side = lambda name, as_name: sets.select(F.col("node").alias(name), F.col("set").alias(as_name))
    both = pairs.filter("NOT clear").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return pairs.filter("clear").select("a", "b").unionByName(both.mapInArrow(judge, "a long, b long"))


def band_cells(spark: SparkSession, nodes: DataFrame, block: int) -> DataFrame:
    """(cell, blocks, mine, node): cells of bands that several nodes share, cut into ``blocks`` parts; ``mine`` is the node's.

    Of cells with the same members, the pairs' usual case, one is kept.
    """
    rows = nodes.select("node", "size", F.explode("bands").alias("cell"))
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("f"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"))
    once = held.filter("n > 1").groupBy("n", "size", "f", "g").agg(F.min("cell").alias("cell"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / BLOCK_SHINGLES)).cast("int")
    shared = rows.join(once.select("cell", blocks.alias("blocks")), "cell")
    return written(spark, shared.select("cell", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"), "node"), "cells", narrow=True)


def walk(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect what reaches ``least``: each set is compared once with all that have not joined yet, which
    are on another side, if there are sides, and have another root."""
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    flags, left, out = np.zeros(int(ids.max()) + 1, np.int32), np.ones(len(sets), bool), []
    for first in range(len(sets)):
        front = [first] if left[first] else []
        left[first] = False
        while front:
            i = front.pop()
            mine = ids[starts[i] : starts[i] + size[i]]
            flags[mine] = 1
            common = np.add.reduceat(flags[ids], starts)
            flags[mine] = 0
            fine = left & (root != root[i]) & (common / (size + size[i] - common) >= least)
            if side is not None:
                fine &= side != side[i]
            for j in np.flatnonzero(fine).tolist():
                out.append((i, j))
                front.append(j)
            left &= ~fine
    return out


def band_links(spark: SparkSession, cells: DataFrame, sets: DataFrame, least: float, roots: DataFrame | None = None) -> DataFrame:
    """(a, b): links of at least ``least`` that connect all such pairs of the same part of a cell, each of them exact.

    With ``roots``, all such pairs of different parts of the same cell that have different roots instead.
    """
    if roots is None:
        rows = cells.select("cell", F.col("mine").alias("i"), F.col("mine").alias("j"), "mine", "node", F.col("node").alias("root"))
    else:
        known = cells.filter("blocks > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("cell")
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("mine"))
        rows = known.join(mixed, "cell").select("cell", "mine", "node", "root", F.explode(others).alias("other"))
        rows = rows.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root")
    dealt = rows.join(sets, "node").select("cell", "i", "j", "mine", "node", "root", "set")
    dealt = dealt.repartition(shuffle_width(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def scan(batches):
        held: list | None = None

        def work(columns, last):
            """Links of all whole cells; the last cell stays for the next batch."""
            cell, first, second, mine, node, root, raw = columns
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
            edges = np.concatenate([[0], change, [len(cell)]])
            whole = len(edges) - 1 if last else len(edges) - 2
            found = set()
            for x, y in zip(edges[:whole].tolist(), edges[1 : whole + 1].tolist()):
                if y - x > 1:
                    own = [np.frombuffer(r, np.uint64) for r in raw[x:y]]
                    if y - x == 2 and first[x] == second[x]:
                        pairs = [(0, 1)] if similarity(*own) >= least else []
                    else:
                        pairs = walk(own, root[x:y], None if first[x] == second[x] else mine[x:y], least)
                    found.update((min(u, v), max(u, v)) for u, v in ((int(node[x + i]), int(node[x + j])) for i, j in pairs))
            flat = np.array(sorted(found), np.int64).reshape(-1, 2)
            return record_batch(LINK_ARROW, [flat[:, 0].copy(), flat[:, 1].copy()]), [c[edges[whole] :] for c in columns]

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [batch.columns[-1].to_pylist()]
            held = columns if held is None else [*[np.concatenate(x) for x in zip(held[:-1], columns[:-1])], held[-1] + columns[-1]]
            found, held = work(held, False)
            yield found
        if held is not None and len(held[0]):
            yield work(held, True)[0]

    return dealt.mapInArrow(scan, "a long, b long").distinct()


def similar_groups(spark: SparkSession, docs: DataFrame, nodes: DataFrame, near: DataFrame, tied: DataFrame, words: int, least: float, block: int, key: str, text: str) -> DataFrame:
    """(node, root) of the groups that verified links and ``tied`` join: candidates are ``near`` and pairs that share a band."""
    pairs, cells = written(spark, plausible(near, nodes, least), "pairs", narrow=True), band_cells(spark, nodes, block)
    in_doubt = pairs.filter("NOT clear")
    sets = shingle_sets(docs, nodes, cells.select("node").unionByName(in_doubt.select(F.col("a").alias("node"))).unionByName(in_doubt.select(F.col("b").alias("node"))), words, key, text)
    found = written(spark, judged(pairs, sets, least).unionByName(band_links(spark, cells, sets, least)), "verified", narrow=True)
    roots = written(spark, components(spark, found.unionByName(tied)), "roots", narrow=True)
    if not cells.filter("blocks > 1").isEmpty():
        more = written(spark, band_links(spark, cells, sets, least, roots), "verified", narrow=True)
        if not more.isEmpty():
            roots = written(spark, components(spark, found.unionByName(more).unionByName(tied)), "roots", narrow=True)
    forget(spark, pairs, cells, sets)
    return roots


def ties(known: DataFrame) -> DataFrame:
    """(a, b): a doc_id with several nodes ties them together. Null ids tie nothing: each such row is a text of its own."""
    known = known.filter("doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("doc_id", "low")
    return known.join(several, "doc_id").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id): the smallest ``first`` of all nodes that links join, null if none of them has an id."""
    joined = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.join(least, "root").select("node", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id", text: str = "text", cell: int = CELL, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``: the smallest doc_id that links can reach, itself included.

    Rows that repeat a doc_id are one document, linked to each other. Rows with a null doc_id are texts of their own, each
    linked by its fingerprint only; component_id is null where links reach no doc_id. With ``least``, a link also needs
    that Jaccard similarity of the two texts' shingle sets, a group is what verified links connect, and rows with a null
    doc_id have no group. Null, empty and blank texts have fingerprint 0 and link like any other. Texts are read whole,
    however long. Other columns of ``docs`` are ignored, whatever their names.
    """
    sets = least is not None
    prints = written(spark, fingerprints(docs, words, key, text, sets), "prints", narrow=not sets)
    rows = prints.select("doc_id", "fp", "node") if sets else prints.withColumn("node", F.col("fp"))
    known = rows.filter("doc_id IS NOT NULL") if sets else rows
    tied = ties(known.select("doc_id", "node"))
    held = [F.first(c).alias(c) for c in ("size", "sig", "bands")] if sets else []
    source = prints.filter("doc_id IS NOT NULL") if sets else known
    nodes = written(spark, source.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first"), *held), "nodes", narrow=True)
    plan = choose(nodes, radius)
    width = tasks_for(spark, nodes.count() * sum(ball(m.bit_count(), t) + 1 for m, t in plan), CELL_ROWS)
    found = written(spark, links(nodes, plan, radius, width, cell), "links", narrow=True)
    if sets:
        roots = similar_groups(spark, docs, nodes, found, tied, words, least, block, key, text)
    else:
        roots = written(spark, components(spark, found.unionByName(tied)), "roots", narrow=True)
    id_of = F.when(F.col("doc_id").isNotNull(), F.col("component_id")) if sets else F.col("component_id")
    out = rows.join(named(nodes, roots), "node", "left").select("doc_id", "fp", id_of.alias("component_id"))
    forget(spark, found)
    return out

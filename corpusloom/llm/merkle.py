"""A Merkle manifest of a dataset: one tree a group of rows, one tree over the groups' roots, and a proof for every row.

The trees are merged as sparse forests. A forest holds unresolved nodes keyed by (tree, level, index); since the number of
leaves of each tree is known, so is the arity of every run of siblings, and as soon as a run is complete it gives way to its
parent. A tree's root becomes a leaf of the tree over the groups. Merging two forests is putting their nodes together, which
is associative and has the empty forest as its unit, so it does not matter which parts of a tree meet first. A task
reads its stretch of the leaves and is left with a few unresolved nodes at each level; these fragments are then reduced as a
tree, FAN of them at a time, each round a written table.

Every completed run is also a row (tree, level, run, digests). These rows are what proofs are made of: SPAN levels of a
tree at a time, blocks of arity^SPAN nodes meet their runs and the path of the block above them. So no task sees more
than a block's nodes at once, and a group with a third of all rows is cut into as many blocks as its size asks for.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import check_kept, forget, tasks_for, written

#: Rows that one task numbers at most, about; fragments merged at once; levels of a block of proofs.
PIECE_ROWS, FAN, SPAN = 1 << 21, 8, 6
TOP, SIZE = -1, 32
RUNS = "tree long, level int, place long, width long, digests binary"
OPEN = f"part long, done boolean, {RUNS}"
OPEN_ARROW = pa.schema([("part", pa.int64()), ("done", pa.bool_()), ("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("width", pa.int64()), ("digests", pa.binary())])


def parent(children: list[bytes]) -> bytes:
    """Digest of a run: SHA-256 of its digests as lowercase hex, one after another."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Forest:
    """Unresolved nodes; :meth:`add` and :meth:`merge` resolve what they complete and collect it in ``done``.

    A tree of ``width`` leaves has ceil(width / arity) nodes on its next level, and so on. ``groups`` is the width of the
    tree over all trees' roots. ``done`` has (tree, level, run, width, digests) of completed runs, and of roots, whose
    level is the tree's height and which are a run of their own.
    """

    def __init__(self, arity: int, groups: int):
        self.arity, self.groups = arity, groups
        self.runs: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.widths: dict[int, int] = {TOP: groups}
        self.done: list[tuple] = []

    def add(self, tree: int, level: int, index: int, digest: bytes, width: int) -> None:
        """Take in a node of a tree with ``width`` leaves."""
        here = width
        for _ in range(level):
            here = -(-here // self.arity)
        while True:
            if here == 1:
                self.done.append((tree, level, 0, width, digest))
                if tree == TOP:
                    return
                tree, level, index, width, here = TOP, 0, tree, self.groups, self.groups
                continue
            run = index // self.arity
            got = self.runs.setdefault((tree, level, run), {})
            got[index] = digest
            if len(got) < min(self.arity, here - run * self.arity):
                self.widths[tree] = width
                return
            children = [got[i] for i in sorted(got)]
            del self.runs[tree, level, run]
            self.done.append((tree, level, run, width, b"".join(children)))
            level, index, digest, here = level + 1, run, parent(children), -(-here // self.arity)

    def open_nodes(self) -> list[tuple]:
        return [(tree, level, i, self.widths[tree], d) for (tree, level, _), got in self.runs.items() for i, d in sorted(got.items())]

    def merge(self, other: Forest) -> Forest:
        for tree, level, index, width, digest in other.open_nodes():
            self.add(tree, level, index, digest, width)
        self.done += other.done
        return self


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row, as lowercase hex."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the range as ``_part``, written."""
    width = tasks_for(spark, rows.count(), PIECE_ROWS)
    return written(spark, rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id().cast("long")), name, narrow=False)


def placed_leaves(spark: SparkSession, leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(leaves with _tree and _index, groups (_g, _tree, _width), tables to forget). Groups and leaves are numbered by ranges
    and by counts a range, so neither many groups nor a large one are in one task."""
    ranged = numbered(spark, leaves, ["_g", "_key", "_leaf", "_row"], "merkle-ranges")
    counts = written(spark, ranged.groupBy("_part", "_g").count(), "merkle-counts", narrow=True)
    groups = numbered(spark, counts.groupBy("_g").agg(F.sum("count").alias("_width")), ["_g"], "merkle-groups")
    first = groups.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_g")) - 1
    trees = written(spark, groups.join(F.broadcast(first), "_part").select("_g", "_width", (F.col("_first") + within).alias("_tree")), "merkle-trees", narrow=True)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_start", before).drop("count").alias("c").join(trees.alias("t"), F.expr("c._g <=> t._g")).select("c._part", "c._g", "_start", "_tree", "_width")
    joined = ranged.alias("r").join(starts.alias("s"), F.expr("r._part = s._part AND r._g <=> s._g")).select("r.*", "_start", "_tree", "_width")
    order = Window.partitionBy("_part", "_g").orderBy("_key", "_leaf", "_row")
    dealt = joined.repartition("_part")
    out = dealt.withColumn("_index", F.col("_start") + F.row_number().over(order) - 1).drop("_start")
    return out, trees, [ranged, counts, groups]


def resolved(spark: SparkSession, leaves: DataFrame, arity: int, groups: int) -> DataFrame:
    """All completed runs of the forest (RUNS): those within each task, then those of merged fragments."""

    def rows_of(part, forest):
        done, left = forest.done, forest.open_nodes()
        forest.done = []
        rows = [(part, True, *r) for r in done] + [(part, False, *r) for r in left]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(OPEN_ARROW)], schema=OPEN_ARROW)

    def scan(batches):
        forest, part, some = Forest(arity, groups), 0, False
        for batch in batches:
            parts, trees, index, width, leaf = (batch.column(i).to_pylist() for i in range(5))
            for t, i, w, d in zip(trees, index, width, leaf):
                forest.add(t, 0, i, d, w)
            if parts:
                part, some = parts[0], True
            done, forest.done = forest.done, []
            yield pa.RecordBatch.from_arrays([pa.array([(part, True, *r)[i] for r in done], f.type) for i, f in enumerate(OPEN_ARROW)], schema=OPEN_ARROW)
        if some:
            yield rows_of(part, forest)

    def reduce(key, pdf):
        forest = Forest(arity, groups)
        for _, nodes in pdf.groupby("part"):
            fragment = Forest(arity, groups)
            for t, level, i, w, d in zip(nodes["tree"], nodes["level"], nodes["place"], nodes["width"], nodes["digests"]):
                fragment.add(int(t), int(level), int(i), bytes(d), int(w))
            forest = forest.merge(fragment)
        return pa.Table.from_batches([rows_of(int(key[0]), forest)]).to_pandas()

    out = written(spark, leaves.select("_part", "_tree", "_index", "_width", "_leaf").mapInArrow(scan, OPEN), "merkle-nodes", narrow=True)
    done, left = out.filter("done"), out.filter("NOT done")
    while not left.isEmpty():
        out = written(spark, left.withColumn("part", F.floor(F.col("part") / FAN)).groupBy(F.col("part").alias("to")).applyInPandas(reduce, OPEN), "merkle-nodes", narrow=True)
        done, left = done.unionByName(out.filter("done")), out.filter("NOT done")
    return done.drop("part", "done")


def step(position: int, digests: bytes) -> bytes:
    """A path's step: place in the run, size of the run, the siblings' digests."""
    at = position * SIZE
    return bytes([position, len(digests) // SIZE]) + digests[:at] + digests[at + SIZE :]


def steps_of(path: bytes):
    """(place, digests of the run with the own one left out) from the leaf up."""
    at = 0
    while at < len(path):
        position, size = path[at], path[at + 1]
        end = at + 2 + (size - 1) * SIZE
        yield position, [path[i : i + SIZE] for i in range(at + 2, end, SIZE)]
        at = end


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that ``leaf`` and the siblings on its path give."""
    for position, siblings in steps_of(path):
        leaf = parent([*siblings[:position], leaf, *siblings[position:]])
    return leaf


def with_paths(nodes: DataFrame | None, runs: DataFrame, above: DataFrame, chunk: int, arity: int) -> DataFrame:
    """Paths of a level's nodes to the root: the steps of SPAN levels from ``runs``, then the path of the block above.

    ``above`` has (tree, block, subroot, path). Without ``nodes`` the result is (tree, block, subroot, path) of every node
    that a run of the lowest level holds, with the node as block; else the rows of ``nodes`` (tree, index and others) with
    subroot and path.
    """
    span, low = arity**SPAN, chunk * SPAN
    height = F.col("level") - low
    mine = runs.filter(F.col("level").between(low, low + SPAN - 1))
    block = F.floor(F.col("place") / F.element_at(F.array(*[F.lit(arity ** (SPAN - 1 - j)) for j in range(SPAN)]), (height + 1).cast("int")))
    rows = mine.select("tree", block.alias("block"), F.lit(1).alias("kind"), height.cast("int").alias("level"), F.col("place").alias("index"), F.col("digests").alias("a"), F.lit(None).cast("binary").alias("b"))
    rows = rows.unionByName(above.select("tree", "block", F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("index"), F.col("path").alias("a"), F.col("subroot").alias("b")))
    more = []
    if nodes is not None:
        more = [c for c in nodes.columns if c not in ("tree", "index")]
        own = nodes.select("tree", F.floor(F.col("index") / span).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "index", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), F.struct(*more).alias("cols"))
        rows = rows.withColumn("cols", F.lit(None).cast(own.schema["cols"].dataType)).unionByName(own)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "index")

    def walk(known, index, path):
        out = []
        for j in range(SPAN):
            digests = known.get((j, index // arity))
            if digests is None:
                break
            out.append(step(index % arity, digests))
            index //= arity
        return b"".join(out) + path

    def scan(batches):
        here, known, path, root = None, {}, b"", b""
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            take, trees, blocks, roots, paths = [], [], [], [], []
            for at, (tree, where, kind, level, index, a, b) in enumerate(zip(*columns)):
                if here != (tree, where):
                    here, known, path, root = (tree, where), {}, b"", b""
                if kind == 0:
                    path, root = a, b
                elif kind == 1:
                    known[level, index] = a
                else:
                    take.append(at)
                    paths.append(walk(known, index, path))
                    roots.append(root)
            if take:
                cols = batch.column(7).take(pa.array(take)).flatten()
                yield pa.RecordBatch.from_arrays([*cols, pa.array(roots, pa.binary()), pa.array(paths, pa.binary())], names=[*more, "subroot", "path"])

    def scan_blocks(batches):
        """Without nodes of their own: those of the lowest runs, once all runs of the block are there."""
        here, known, path, root = None, {}, b"", b""

        def give():
            rows = [(here[0], run * arity + m, root) for (level, run), d in known.items() if level == 0 for m in range(len(d) // SIZE)]
            values = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [walk(known, r[1], path) for r in rows]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["tree", "block", "subroot", "path"])

        for batch in batches:
            for tree, where, kind, level, index, a, b in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if here != (tree, where):
                    if known:
                        yield give()
                    here, known, path, root = (tree, where), {}, b"", b""
                if kind == 0:
                    path, root = a, b
                else:
                    known[level, index] = a
        if known:
            yield give()

    if nodes is None:
        return dealt.mapInArrow(scan_blocks, "tree long, block long, subroot binary, path binary")
    return dealt.mapInArrow(scan, nodes.select(*more, F.lit(b"").alias("subroot"), F.lit(b"").alias("path")).schema)


def chunks_of(width: Column, arity: int, most: int) -> Column:
    """How many times SPAN levels a tree of ``width`` leaves has, given that none has more than ``most``."""
    out = F.lit(0)
    for c in range(most):
        out = out + (width > arity ** (SPAN * c)).cast("int")
    return out


def merkle_manifest(
    spark: SparkSession, docs: DataFrame, fields: tuple = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source", arity: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """key, the columns ``keep``, leaf, subroot, root (lowercase hex) and path (binary, see :func:`steps_of`) for every row.

    A leaf is the digest of the row's ``fields``. In a group leaves ascend by ``key``; a null key comes first, and rows that
    repeat a key follow each other by their digests, each with a place of its own. Groups ascend bytewise, null first. Texts
    are hashed whole where they are read, null and empty ones too, and only digests move. An empty table gives an empty
    result. Columns of ``docs`` beyond ``fields`` and ``keep`` are ignored, whatever their names; a column of ``keep`` with the
    name of a column of the result is an error.
    """
    if not 2 <= arity <= 255:
        raise ValueError("an arity between 2 and 255")
    keep = check_kept(keep, [key, "leaf", "subroot", "root", "path"])
    rows = docs.select(
        F.col(group).cast("string").alias("_g"), F.col(key).alias("_key"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("_leaf"),
        F.monotonically_increasing_id().alias("_row"), F.struct(F.col(key).alias(key), *keep).alias("_own"),
    )
    leaves = written(spark, rows, "merkle-leaves", narrow=True)
    places, trees, used = placed_leaves(spark, leaves)
    groups, widest = trees.agg(F.count("*"), F.max("_width")).first()
    if not groups:
        return leaves.select("_own.*", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], F.lit(b"").alias("path"))
    placed = written(spark, places, "merkle-placed")
    forget(spark, leaves, *used)
    runs = resolved(spark, placed, arity, groups)
    levels = lambda width: next(h for h in range(200) if arity**h >= width)
    chunks, top_chunks = -(-levels(widest) // SPAN), -(-levels(groups) // SPAN)
    # a root is its tree's run at the tree's height; other runs have siblings
    root_of = F.element_at(F.array(*[F.lit(arity**h).cast("double") for h in range(levels(max(widest, groups)) + 1)]), (F.col("level") + 1).cast("int"))
    is_root = (F.octet_length("digests") == SIZE) & (root_of >= F.col("width"))
    roots, inner = runs.filter(is_root), runs.filter(~is_root)
    root = bytes(roots.filter(F.col("tree") == TOP).first()["digests"]).hex()

    above = spark.createDataFrame([(TOP, 0, b"", b"")], "tree long, block long, subroot binary, path binary")
    over = inner.filter(F.col("tree") == TOP)
    for c in reversed(range(top_chunks)):
        above = with_paths(None, over, above, c, arity)
    tops = above.select(F.col("block").alias("tree"), "path")
    sub = roots.filter(F.col("tree") != TOP).select("tree", "width", F.col("digests").alias("subroot"))
    starts = written(spark, sub.join(tops, "tree").withColumn("chunks", chunks_of(F.col("width"), arity, chunks)), "merkle-starts", narrow=True)
    under = inner.filter(F.col("tree") != TOP)
    blocks = lambda c: starts.filter(F.col("chunks") == c).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
    above = blocks(chunks)
    for c in reversed(range(1, chunks)):
        above = with_paths(None, under, above, c, arity).unionByName(blocks(c))
    if chunks:  # trees of one leaf have no run, and find their path as that of their only block
        above = above.unionByName(blocks(0))
    own = placed.select(F.col("_tree").alias("tree"), F.col("_index").alias("index"), "_own", "_leaf")
    out = with_paths(own, under, above, 0, arity)
    hexed = lambda c: F.lower(F.hex(c))
    return out.select("_own.*", hexed("_leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root).alias("root"), "path")


def checked(manifest: DataFrame, leaf: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, proof_sha256 (of all siblings' digests as hex, from the leaf up) and folded_root (from the
    digest in column ``leaf`` and the row's path; a null digest folds to null)."""

    def scan(batches):
        for batch in batches:
            n = len(keep)
            leaves, paths = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            proofs = [sha256("".join(s.hex() for _, some in steps_of(p) for s in some).encode()).hexdigest() for p in paths]
            folded = [fold(bytes.fromhex(x), p).hex() if x is not None else None for x, p in zip(leaves, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=[*keep, "proof_sha256", "folded_root"])

    rows = manifest.select(*keep, F.col(leaf).alias("_a"), F.col("path").alias("_b"))
    return rows.mapInArrow(scan, manifest.select(*keep, F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root")).schema)

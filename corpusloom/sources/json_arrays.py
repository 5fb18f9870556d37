"""JSON arrays of objects read by many tasks, whatever their line breaks.

Spark's text reader cuts a file into byte ranges and a range into pieces that end with ``}``; it reads from any store. Where a
piece begins, it may be inside a string or at any depth. So each range is read twice. First it tells what it does to a
scanner that enters it outside a string, and to one that enters it inside: where it leaves, and how much deeper. These few
numbers a range, composed in order, give the state at the start of each. Then every range knows which of its braces
close an object of the array, and gives these objects; what it has of an object that began before or ends later is stitched
together with the other parts, one or two a range.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ESCAPED = re.compile(r"\\.", re.DOTALL)
EFFECTS = "path string, block long, outside_ends_in boolean, outside_depth long, inside_ends_in boolean, inside_depth long, first string"


def effect(piece: str, inside: bool) -> tuple[bool, int]:
    """(whether a scanner leaves the piece inside a string, change of depth) if it enters inside one or not."""
    parts = ESCAPED.sub("", piece).split('"')
    outer = "".join(parts[1 if inside else 0 :: 2])
    depth = outer.count("{") + outer.count("[") - outer.count("}") - outer.count("]")
    return (len(parts) % 2 == 0) != inside, depth


def pieces_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def range_effects(pieces: DataFrame) -> list:
    """What each range does to a scanner: one row a range."""

    def scan(batches):
        here, state, rows = None, None, []
        for batch in batches:
            for path, block, value in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if here != (path, block):
                    if here:
                        rows.append((*here, *state))
                    here, state = (path, block), [False, 0, True, 0, value.lstrip()[:1]]
                for k in (0, 2):
                    state[k], change = effect(value + "}", state[k])
                    state[k + 1] += change
        if here:
            rows.append((*here, *state))
        names = [x.split()[0] for x in EFFECTS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return pieces.select("path", "block", "value").mapInArrow(scan, EFFECTS).collect()


def starts_of(effects: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(inside a string, depth, depth of the array's elements) at the start of each range."""
    out, state = {}, {}
    for r in sorted(effects, key=lambda r: (r["path"], r["block"])):
        base = state[r["path"]][2] if r["path"] in state else int(r["first"] == "[")
        inside, depth, _ = state.get(r["path"], (False, 0, base))
        out[r["path"], r["block"]] = (inside, depth, base)
        kind = "inside" if inside else "outside"
        state[r["path"]] = (r[f"{kind}_ends_in"], depth + r[f"{kind}_depth"], base)
    return out


def object_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the text of every object of the arrays in ``path``."""
    pieces = pieces_of(spark, path)
    starts = starts_of(range_effects(pieces))
    sent = spark.sparkContext.broadcast(starts)  # a few numbers a byte range

    def scan(batches):
        """(path, block, part, value): part 0 is the end of an object that began before, 1 a whole one, 2 a beginning; -1 all of
        a range inside one object."""
        here, inside, depth, base, held, opened = None, False, 0, 0, [], False

        def rest():
            if not held:
                return []
            text = "".join(held)
            if opened:  # the object began in this range and goes on
                return [(*here, 2, text[text.find("{") :])] if "{" in text and depth > base else []
            return [(*here, -1, text)]

        for batch in batches:
            rows = []
            for path, block, value in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if here != (path, block):
                    rows += rest()
                    here, held = (path, block), []
                    inside, depth, base = sent.value[path, block]
                    opened = depth <= base and not inside
                piece = value + "}"
                inside, change = effect(piece, inside)
                depth += change
                held.append(piece)
                if not inside and depth <= base:
                    text = "".join(held)
                    if not opened:
                        rows.append((*here, 0, text))
                    elif "{" in text:  # and not the end of the array
                        rows.append((*here, 1, text[text.find("{") :]))
                    held, opened = [], True
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "block", "part", "value"])
        rows = rest()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)] if rows else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.int32(), pa.string())], names=["path", "block", "part", "value"])

    found = pieces.select("path", "block", "value").mapInArrow(scan, "path string, block long, part int, value string")
    whole = found.filter("part = 1").select("value")
    place = F.struct("block", F.when(F.col("part") == 0, 0).when(F.col("part") == -1, 1).otherwise(2).alias("nth"), "value")
    order = Window.partitionBy("path").orderBy("block", F.when(F.col("part") == 2, 1).otherwise(0))
    cut = found.filter("part <> 1").withColumn("began", F.sum((F.col("part") == 2).cast("int")).over(order))
    parts = cut.groupBy("path", "began").agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["value"]).alias("parts"), F.count_if(F.col("part") == 0).alias("ends"))
    return whole.unionByName(parts.filter("ends > 0").select(F.array_join("parts", "").alias("value")))


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """The objects of JSON arrays as rows. Ranges are of ``spark.sql.files.maxPartitionBytes`` at most. Files of one object, or of
    objects one after another, are read alike; an object that does not parse is a row of nulls, one that has no end is none."""
    return object_texts(spark, path).select(F.from_json("value", schema).alias("o")).select("o.*")

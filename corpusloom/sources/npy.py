"""Matrices in ``.npy`` files as a data source: rows in ranges, pruned by their numbers; writes that show when they are whole.

``path`` is a file, or a folder of parts that are one matrix in the order of their names. A task reads a range of rows; of a
filter on ``row`` only the ranges it can hold are read. A write puts parts of PART_ROWS rows in a folder of its own beside
the matrix, and the commit moves them in; a task that fails, or is run twice, leaves nothing there. Files are opened
through Arrow's file systems, by path or URI.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from corpusloom.errors import SettingsError

#: Rows of a range that is read, and of a part that is written.
RANGE_ROWS, PART_ROWS = 1 << 14, 1 << 16
SCHEMA = "row long, vec array<float>"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def header(stream) -> tuple[int, int, np.dtype, int]:
    """(rows, columns, kind, bytes before the numbers) of a file."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if fortran or len(shape) != 2 or kind.kind not in "fiu":
        raise SettingsError(f"a matrix of numbers, row by row, is read, not {shape} of {kind}")
    return shape[0], shape[1], kind, stream.tell()


@dataclass
class Range(InputPartition):
    path: str
    first: int  # number of its first row in the whole matrix
    rows: int
    columns: int
    kind: str
    offset: int

    def __init__(self, path, first, rows, columns, kind, offset):
        super().__init__((path, first))
        self.path, self.first, self.rows, self.columns, self.kind, self.offset = path, first, rows, columns, kind, offset


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("rows", RANGE_ROWS))
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("row",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)

    def files(self) -> list[str]:
        fs, path = opened(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [path]
        found = fs.get_file_info(pafs.FileSelector(path))
        return sorted(f.path for f in found if f.path.endswith(".npy") and f.type == pafs.FileType.File)

    def partitions(self) -> list[Range]:
        fs, _ = opened(self.path)
        out, first = [], 0
        for path in self.files():
            with fs.open_input_file(path) as stream:
                rows, columns, kind, offset = header(stream)
            low, high = max(0, self.low - first), rows if self.high is None else min(rows, self.high - first)
            for at in range(low, high, self.each):
                n = min(self.each, high - at)
                out.append(Range(path, first + at, n, columns, kind.str, offset + at * columns * kind.itemsize))
            first += rows
        return out

    def read(self, partition: Range):
        if partition is None:
            return
        kind = np.dtype(partition.kind)
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as stream:
            stream.seek(partition.offset)
            raw = stream.read(partition.rows * partition.columns * kind.itemsize)
        values = np.frombuffer(raw, kind).astype(np.float32)
        ends = np.arange(partition.rows + 1, dtype=np.int32) * partition.columns
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + partition.rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["row", "vec"])


@dataclass
class Parts(WriterCommitMessage):
    task: int
    names: list[str]


class NpyWriter(DataSourceArrowWriter):
    """Rows of ``vec`` in the order of tasks and of rows in them; ``row`` is not written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.each, self.overwrite = options["path"], int(options.get("rows", PART_ROWS)), overwrite
        self.work = f"{opened(self.path)[1].rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, batches):
        from pyspark import TaskContext

        fs, _ = opened(self.path)
        task, names, held, count = TaskContext.get().partitionId(), [], [], 0
        fs.create_dir(self.work)

        def put(rows):
            name = f"{self.work}/{task:06d}-{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(name) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": rows.shape})
                out.write(np.ascontiguousarray(rows, "<f4").tobytes())
            names.append(name)

        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vec"))
            if vectors.null_count or not len(vectors):
                if len(vectors):
                    raise SettingsError("a matrix has no null rows")
                continue
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            held.append(flat.reshape(len(vectors), -1).astype(np.float32))
            count += len(vectors)
            while count >= self.each:
                rows = np.concatenate(held)
                put(rows[: self.each])
                held, count = [rows[self.each :]], count - self.each
        if count:
            put(np.concatenate(held))
        return Parts(task, names)

    def commit(self, messages):
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".npy")]
        begin = 0 if self.overwrite else len(old)
        names = [n for m in sorted((m for m in messages if m), key=lambda m: m.task) for n in m.names]
        for name in old if self.overwrite else []:
            fs.delete_file(name)
        for i, name in enumerate(names):
            fs.move(name, f"{path.rstrip('/')}/part-{begin + i:08d}.npy")
        self.abort(messages)

    def abort(self, messages):
        fs, _ = opened(self.path)
        if fs.get_file_info(self.work).type == pafs.FileType.Directory:
            fs.delete_dir(self.work)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)


def read_matrix(spark: SparkSession, path: str, rows: int = RANGE_ROWS) -> DataFrame:
    """row (from 0), vec of a matrix; a task for every ``rows`` rows."""
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy").option("rows", str(rows)).load(path)


def write_matrix(df: DataFrame, path: str, order: str, vec: str = "vec", rows: int = PART_ROWS) -> None:
    """Replace the matrix in folder ``path`` by the vectors of ``df`` in the order of a column; all of one length, none null."""
    df.sparkSession.dataSource.register(NpySource)
    held = df.select(order, df[vec].cast("array<float>").alias("vec")).repartitionByRange(order).sortWithinPartitions(order)
    held.select("vec").write.format("npy").option("rows", str(rows)).mode("overwrite").save(path)

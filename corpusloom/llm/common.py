"""Shared helpers: the shared folder, written intermediate tables, byte views of Arrow columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and all runs in one machine (tests) a temporary folder is used; a cluster without
    the setting is an error, since its executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, folder, True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder, and read it back.

    ``narrow``: small rows, merged to partitions of a useful size and written by no more tasks than there are cores, or so
    that wide shuffles do not leave many tiny files.
    """
    path = new_path(spark, name)
    few = max(spark.sparkContext.defaultParallelism, shuffle_width(spark) // 8)
    (df.hint("rebalance").coalesce(few) if narrow else df).write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._corpusloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """From now on the session of ``df`` hands Python at most about BATCH_BYTES at once, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut_by_bytes(batch: pa.RecordBatch, column: int, amount: int):
    """Consecutive pieces of ``batch`` with about ``amount`` bytes of a binary column each; a longer value is in a piece of
    its own, or with a few short ones before it."""
    share = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // amount
    borders = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for at, stop in zip(borders, borders[1:]):
        if at < stop:
            yield batch.slice(at, stop - at)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks so that none gets much more than ``each`` of ``amount``; as many as the session shuffles to at least."""
    return max(shuffle_width(spark), -(-amount // each))


def input_bytes(df: DataFrame) -> int:
    """What the optimiser takes the size of ``df`` for: the size of its files where it is a projection of a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores before it until no column of ``taken`` has that name."""
    lower = {t.lower() for t in taken}
    while base.lower() in lower:
        base = "_" + base
    return base


def check_kept(keep: list[str] | None, made: list[str]) -> list[str]:
    """``keep`` as a list; an error if one of these columns has the name of a column the operator makes."""
    clash = {k.lower() for k in keep or []} & {m.lower() for m in made}
    if clash:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    return list(keep or [])


def utf8(column: str = "text"):
    """Null texts count as empty; Python then gets bytes and decodes nothing."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

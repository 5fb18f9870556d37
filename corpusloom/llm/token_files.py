"""Token-id files: documents in ascending id order, coded by :mod:`rans`, written in parallel and read back.

The container is a Parquet table of binary segments, one for about ``SEGMENT_IDS`` ids, so that any store Spark can
write gets whole files or none, and a lost task is simply run again. Columns: file (number in id order), segment, ids
(count), data. Segments end at document ends. A task holds one segment's ids at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import input_bytes, new_path, record_batch, small_batches, tasks_for
from corpusloom.llm.encoding import slices, worker_encoder
from corpusloom.llm.rans import encode_segment, read_segment

SEGMENT_IDS = 1 << 21
#: Bytes of input a file, and a bound on files where the optimiser can only guess the size.
FILE_BYTES, MOST_FILES = 256 << 20, 500_000
FILE_SCHEMA = "file long, segment long, n_ids long, data binary"
FILE_ARROW = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
READ_ARROW = pa.schema([("file", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, path: str, files: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text (null: empty), add ``end_id``, write ``files`` files in ascending key order.

    Null keys come first. Rows that repeat a key stay, next to each other in any order; the row number in the sort key
    lets a hot key spread over files. A text of any length is coded whole and ends its segment. Other columns of ``docs``
    are ignored, whatever their names. An empty table gives files without rows.
    """
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(files, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        encoder, file, segment, before = worker_encoder(tokenizer, spaced), TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal keys, parts, held, segment, before
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            ids = np.frombuffer(b"".join(parts), "<u4")
            null = np.array([k is None for k in keys], bool)
            known = np.array([k or 0 for k in keys], np.int64)
            batch = record_batch(FILE_ARROW, [[file], [segment], [len(ids)], [encode_segment(known, lengths, ids, before, null)]])
            keys, parts, held, segment, before = [], [], 0, segment + 1, before + len(ids)
            return batch

        for batch in batches:
            for some in slices(batch, 1):
                for k, ids in zip(some.column(0).to_pylist(), encoder(some.column(1))):
                    keys.append(k)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
        if keys:
            yield flush()

    dealt.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32), decoded from the files."""
    table = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = {r["file"]: r["n"] for r in table.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}  # a row a file
    order = np.array(sorted(sums), np.int64)
    starts = np.concatenate([[0], np.cumsum([sums[f] for f in order.tolist()])]).astype(np.int64)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                doc_ids, lengths, ids, before, null = read_segment(batch.column(1)[i].as_py())
                base = starts[np.searchsorted(order, file)] + before
                ends = np.cumsum(lengths)
                raw, step = ids.astype("<u4").tobytes(), 512
                for a in range(0, len(doc_ids), step):
                    b = min(len(doc_ids), a + step)
                    yield record_batch(READ_ARROW, [np.full(b - a, file), pa.array(doc_ids[a:b], mask=null[a:b]), base + ends[a:b] - lengths[a:b], lengths[a:b], [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[a:b].tolist(), lengths[a:b].tolist())]])

    out = table.select("file", "data").mapInArrow(decode, "file long, doc_id long, place long, n_tokens long, ids binary")
    return out.select("doc_id", F.col("place").alias("start"), "n_tokens", "ids")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, spaced: bool = False, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write ``docs`` to new token files in the shared folder and return what reading them gives.

    ``files``: as many as the session shuffles to, and more where a file would get over FILE_BYTES of input.
    """
    path = new_path(spark, "token-files")
    files = files or min(MOST_FILES, tasks_for(spark, input_bytes(docs), FILE_BYTES))
    write_token_files(spark, docs, tokenizer, spaced, end_id, path, files)
    return read_token_files(spark, path)



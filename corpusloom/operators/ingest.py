"""Checks, profiles, hashes and exact dedup of document tables."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.errors import InvalidDocument
from corpusloom.operators.keeping import kept
from corpusloom.functions.text import digest, strip

#: The columns a corpus has to have.
REQUIRED = ["document_id", "jurisdiction", "law_id", "law_name", "article_id", "raw_text", "normalized_text", "embedding_text"]


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def validated(docs: DataFrame, required: list[str] | None = None, text: str = "raw_text") -> DataFrame:
    """Add is_valid and reason (null if valid): every required column there, and a text that is not blank."""
    missing = [c for c in (required or REQUIRED) if c not in docs.columns]
    if missing:
        reason = F.lit(f"missing: {', '.join(missing)}")
    else:
        reason = F.when(F.col(text).isNull(), "text is null").when(blank(F.col(text)), "text is blank")
    return docs.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def first_invalid(docs: DataFrame, order: str = "idx", **options) -> DataFrame:
    """One row: the smallest position of an invalid row and its reason, or nulls."""
    bad = validated(docs, **options).filter(~F.col("is_valid"))
    return bad.agg(F.min(order).alias("idx"), F.min_by("reason", order).alias("reason"))


def require_valid(docs: DataFrame, order: str = "idx", **options) -> DataFrame:
    row = first_invalid(docs, order, **options).first()
    if row["reason"] is not None:
        raise InvalidDocument(f"document {row['idx']}: {row['reason']}")
    return docs


def missing_by(docs: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """Rows in which each of ``columns`` is null or blank, of all or of each value of ``group`` (a law, a jurisdiction)."""
    rows = docs.groupBy(group) if group else docs.groupBy()
    return rows.agg(F.count("*").alias("n_documents"), *[F.count_if(blank(F.col(c))).alias(f"missing_{c}") for c in columns])


def profile_by(docs: DataFrame, group: str, text: str, key: str) -> DataFrame:
    """Counts per group: rows, empty texts, distinct ids, texts with replacement characters."""
    return docs.groupBy(group).agg(
        F.count("*").alias("n_documents"),
        F.count_if(blank(F.col(text))).alias("n_empty"),
        F.countDistinct(key).alias("n_ids"),
        F.count_if(F.col(text).contains("�")).alias("n_encoding"),
        F.max(F.length(text)).cast("long").alias("max_chars"),
    )


def repeated(docs: DataFrame, content: str, key: str) -> DataFrame:
    """Hashes of contents that more than one row has, with how many and the smallest id."""
    return docs.groupBy(digest(F.col(content)).alias("doc_hash")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")


def dedup_exact(docs: DataFrame, content: str, key: str) -> DataFrame:
    """One row a distinct content: the one with the smallest id. Only hashes and ids are grouped."""
    first = docs.groupBy(digest(F.col(content)).alias("doc_hash")).agg(F.min(key).alias(key))
    return first


def ordered_digest(docs: DataFrame, order: str, part: Column, separator: str = "|", length: int | None = None) -> DataFrame:
    """One row: SHA-256 over the parts of all rows in order, parts of equal order by themselves; null parts are left out.

    A digest of one string is made by one task, by definition. It reads the parts in order from a sort that spills, and
    holds a batch of them at a time, so memory does not grow; tables beyond an hour of that use :func:`tree_digest`.
    """

    def stream(batches):
        h, first = sha256(), True
        for batch in batches:
            parts = [p for p in batch.column(0).to_pylist() if p is not None]
            if parts:
                h.update((("" if first else separator) + separator.join(parts)).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["h"])

    rows = docs.select(F.col(order).alias("o"), part.cast("string").alias("p")).repartition(1).sortWithinPartitions("o", "p")
    whole = F.coalesce(F.max("h"), F.lit(sha256().hexdigest()))
    return rows.select("p").mapInArrow(stream, "h string").agg((F.substring(whole, 1, length) if length else whole).alias("corpus_hash"))


def tree_digest(docs: DataFrame, order: str, part: Column, fan: int = 4096) -> DataFrame:
    """One row: a digest for tables of any size. Hashes of runs of ``fan`` positions, then, as long as the largest position
    leaves more than ``fan`` of them, hashes of runs of hashes; last the hash of what is left. A task sees ``fan`` at a time."""
    merged = lambda row: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["p"]), "|"), 256).alias("p")
    rows = docs.select(F.floor(F.col(order) / fan).alias("run"), F.struct(F.col(order), part.alias("p")).alias("s"))
    level = rows.groupBy("run").agg(merged("s"))
    runs = (docs.agg(F.max(order)).first()[0] or 0) // fan + 1
    while runs > fan:
        level = level.select(F.floor(F.col("run") / fan).alias("up"), F.struct("run", "p").alias("s")).groupBy("up").agg(merged("s")).withColumnRenamed("up", "run")
        runs = -(-runs // fan)
    return level.agg(merged(F.struct("run", "p")).alias("corpus_hash"))


def numbered(docs: DataFrame, order: str) -> DataFrame:
    """Add idx, the position by ``order`` from 0, without sorting the table in one task: counts of ranges first."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that both readers see the same ranges
    ranged = kept(docs.repartitionByRange(width, order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = ranged.groupBy("_part").count()
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = before.select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_start"))  # a row a partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(start), "_part").withColumn("idx", F.col("_start") + local - 1).drop("_part", "_start")

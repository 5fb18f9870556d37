"""Incremental ingest of staged documents: check, hash, drop what is known, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import digest
from corpusloom.operators.ingest import validated
from corpusloom.sources.files import CORPUS, exists


def ingest_batch(spark: SparkSession, batch: DataFrame, table: str) -> None:
    """Append the valid documents of a micro-batch whose content is not in ``table`` yet; once each."""
    good = validated(batch).filter("is_valid").drop("reason", "is_valid").withColumn("doc_hash", digest(F.col("raw_text"))).dropDuplicates(["doc_hash"])
    if exists(spark, table):
        good = good.join(spark.read.parquet(table).select("doc_hash"), "doc_hash", "left_anti")
    good.write.mode("append").parquet(table)


def ingest_stream(spark: SparkSession, staging: str, table: str, checkpoint: str):
    """Start a query that takes over what is staged so far and stops."""
    source = spark.readStream.schema(CORPUS).json(staging)
    return source.writeStream.foreachBatch(lambda df, _: ingest_batch(df.sparkSession, df, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

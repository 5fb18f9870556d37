"""The stages of the corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars); columns beyond these are
left out. Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.classifiers import crc_of, identify_language, learn_language
from corpusloom.llm.decontaminate import contamination
from corpusloom.llm.encoding import default_path
from corpusloom.llm.line_dedup import LineIndex, strip_shared_lines
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS, RADIUS, SIMILARITY = 5, 10, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, and texts without any letter (``und``). Where lang is null it becomes
    the predicted one. Repeated rows and rows with a null id are judged each on its own, texts of any length whole."""
    model = learn_language(docs, F.coalesce(crc_of("doc_id") % 4 != 2, F.lit(True)))
    out = identify_language(spark, docs.select(COLUMNS), model, keep=["lang", "source", "n_chars", "text"])
    return out.filter(F.col("_lang_pred") != "und").withColumn("lang", F.coalesce("lang", "_lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds too go; a document that loses all its lines goes as well. Rows that repeat a
    doc_id are one document; rows with a null id keep all their lines; null and empty texts lose none and stay."""
    index = LineIndex(spark)
    index.insert(docs)
    out = strip_shared_lines(index, docs, keep=["lang", "source"])
    text = F.col("kept").cast("string")
    return out.filter((F.length("kept") > 0) | (F.col("n_dropped") == 0)).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Fingerprints of five-word shingles make a pair a candidate at RADIUS differing bits, and so does any of 36 bands of
    six minwise hashes, which a pair with a Jaccard similarity of 0.8 shares with a probability of 0.99998. A link needs
    that similarity of the shingle sets. Documents with a null id have no place in a group and stay; null, empty and
    blank texts are alike, as are equal ones of fewer than five words. Rows that repeat a doc_id stay or go together.
    """
    groups = near_duplicates(spark, docs, words=WORDS, radius=RADIUS, least=SIMILARITY)
    lost = groups.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.select(COLUMNS).join(lost, "doc_id", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Null and empty texts stay; repeated rows and rows with a null id are judged
    each on its own, texts of any length whole."""
    out = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["lang", "source", "n_chars", "text"])
    return out.filter(F.size("items") == 0).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with the sequence and offset each of them goes to. Null and empty texts are the end id
    alone; repeated rows are packed each on its own; a null id stays null; columns but doc_id and text are ignored."""
    packed = pack_documents(spark, docs, default_path("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=1024)
    return packed.assign(packed.pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"))

"""Okapi BM25 as an inverted index: postings, terms and corpus statistics are ordinary tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.keeping import kept

K1, B = 1.5, 0.75


#: Stands for a document itself among its terms, so that one pass over the texts gives postings and lengths; no token is empty.
MARK = ""


@dataclass
class LexicalIndex:
    """``table`` (idx, term, tf, dl): postings, and a row with term MARK for every document. Written or kept by the caller if
    used more than once. Counts that are known already (documents, mean length, df by term) are not counted again."""

    table: DataFrame
    documents: int | None = None
    mean_length: float | None = None
    frequencies: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.table.filter(F.col("term") != MARK)

    @property
    def lengths(self) -> DataFrame:
        return self.table.filter(F.col("term") == MARK).select("idx", "dl")

    def kept(self) -> LexicalIndex:
        """The same, kept in memory or on the executors' disks for the times a search reads it, until the next search keeps
        its own."""
        return replace(self, table=kept(self.table, "postings"))

    def sizes(self) -> tuple[int, int]:
        """Numbers of documents and of postings in ``table``, by one pass over its terms."""
        rows = self.table.agg(F.count_if(F.col("term") == MARK).alias("n"), F.count_if(F.col("term") != MARK).alias("m")).first()
        return rows["n"], rows["m"]

    def stats(self) -> DataFrame:
        if self.documents is not None:
            return self.table.sparkSession.range(1).select(F.lit(self.documents).cast("long").alias("n"), F.lit(self.mean_length).cast("double").alias("avgdl"))
        return corpus_stats(self.lengths)

    def terms(self) -> DataFrame:
        """term, df, idf; the idf is positive for every df."""
        df = self.postings.groupBy("term").agg(F.count("*").alias("df")) if self.frequencies is None else self.frequencies
        n = self.stats().select("n").scalar()
        return df.withColumn("idf", idf(n, F.col("df")))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl of documents with lengths ``dl``."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def spread(docs: DataFrame) -> DataFrame:
    """A table read from fewer splits than there are cores, dealt to all of them; larger tables are left alone."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def build_index(docs: DataFrame, key: str, words: Column, only: DataFrame | None = None) -> LexicalIndex:
    """Index ``words`` (an array column) of each row. ``only`` (column term) keeps just the terms that will be asked."""
    cut = docs.select(F.col(key).alias("idx"), F.coalesce(words, F.expr("cast(array() as array<string>)")).alias("words"))
    rows = cut.select("idx", F.size("words").alias("dl"), F.explode(F.concat("words", F.array(F.lit(MARK)))).alias("term"))
    if only is not None:
        mark = docs.sparkSession.range(1).select(F.lit(MARK).alias("term"))
        rows = rows.join(only.select("term").distinct().unionByName(mark), "term", "left_semi")
    return LexicalIndex(rows.groupBy("idx", "dl", "term").agg(F.count("*").alias("tf")))


def vocabulary(docs: DataFrame, words: Column) -> DataFrame:
    """term, df, idf of a whole table, without its postings: each document's distinct words are counted where they are read."""
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    df = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", idf(n, F.col("df")))


def impact(avgdl: Column, k1: float, b: float) -> Column:
    """What a term adds to a document's score, but for its idf."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))


def weighted_terms(index: LexicalIndex, queries: DataFrame, query: str, words: str) -> DataFrame:
    """query, term, df, idf of the terms of each query that the index knows. Repeated query terms count once."""
    return queries.select(query, F.explode(F.array_distinct(words)).alias("term")).join(index.terms(), "term")


def bm25_scores(index: LexicalIndex, queries: DataFrame, query: str = "qid", words: str = "words", k1: float = K1, b: float = B) -> DataFrame:
    """query, idx, score of all documents that share a term with a query. Repeated query terms count once."""
    avgdl = index.stats().select("avgdl").scalar()
    weighted = weighted_terms(index, queries, query, words)
    part = F.col("idf") * impact(avgdl, k1, b)
    return index.postings.join(weighted, "term").groupBy(query, "idx").agg(F.round(F.sum(part), 6).alias("score"))


def top(scores: DataFrame, k: int, query: str = "qid", order: tuple = ("idx",)) -> DataFrame:
    """The k best rows of each query, rank from 1; ties by ``order``. Spark limits groups before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), *[F.asc(c) for c in order])
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def padded_top(scores: DataFrame, queries: DataFrame, lengths: DataFrame, k: int, query: str = "qid", words: str = "words") -> DataFrame:
    """Exactly k rows a query with words: documents without a score fill up with 0 in order of their position.

    Among the first k + m positions at least k have no score when m do, and m <= k for the k best; so the 2 k smallest
    positions are enough, and nothing is paired with the whole table. They are added to every query, and a document
    that has a score keeps it, so ``scores`` are made once. A query without words has no rows.
    """
    best = top(scores, k, query).select(query, "idx", "score")
    first = lengths.select("idx").orderBy("idx").limit(2 * k).agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    fill = queries.filter(F.size(words) > 0).select(query, F.explode(first.select("ids").scalar()).alias("idx"), F.lit(0.0).alias("score"))
    return top(best.unionByName(fill).groupBy(query, "idx").agg(F.max("score").alias("score")), k, query)

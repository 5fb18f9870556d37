"""The whole path as one plan over a batch of queries: retrieve, fuse, select, ground, generate, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import RetrievalError, SettingsError
from corpusloom.functions.models import Backend, ExtractiveBackend, generated, composed, hashed_encoder, overlap_score
from corpusloom.functions.text import has_injection, lexical_text, pair_text, tokens
from corpusloom.operators.answers import parsed_answer
from corpusloom.operators.blockmax import blockmax_topk
from corpusloom.operators.dense import dense_topk
from corpusloom.operators.evidence import citation_warnings, grounded_context, select_evidence
from corpusloom.operators.fusion import fused, hybrid_union, unfused
from corpusloom.operators.lexical import LexicalIndex, build_index, padded_top
from corpusloom.operators.segments import SegmentedCorpus
from corpusloom.plans.params import Params


class Service:
    """Questions against a table of documents (idx, document_id, law_name, article_id, text).

    Without ``docs`` the corpus is the one under ``root``, which ``ingest``, ``delete`` and ``index`` change: documents, postings
    and vectors are made once, when they come in, and every service over ``root`` answers from them.

    ``encoder`` is a vectorised UDF; ``reranker`` takes (query tokens, text tokens) and gives a score column, or is None.
    Texts are joined back last, to the few hits that stay.
    """

    def __init__(
        self, docs: DataFrame | None = None, params: Params | None = None, encoder=None, reranker=overlap_score, vectors: DataFrame | None = None, pad_zero: bool = False, root: str | None = None
    ):
        if (docs is None) == (root is None):
            raise SettingsError("a service has either a table of documents or the folder of a corpus")
        self.params, self.encoder, self.reranker, self.pad_zero = params or Params(), encoder or hashed_encoder(), reranker, pad_zero
        self.words = tokens(lexical_text(F.col("law_name"), F.col("text")), self.params.profile)
        self.corpus, self.docs, self.vectors = None, docs, vectors
        if docs is None:
            vector = {"vec": self.encoder(F.coalesce("text", F.lit("")))}
            self.corpus = SegmentedCorpus(SparkSession.active(), root, self.words, vector, lambda d: composed(d, "law_name", "text"))
        elif vectors is None:
            self.vectors = docs.select("idx", self.encoder(F.coalesce("text", F.lit(""))).alias("vec"))

    def _corpus(self) -> SegmentedCorpus:
        if self.corpus is None:
            raise RetrievalError("this service answers from a table, which it does not change; give it a root")
        return self.corpus

    def ingest(self, docs: DataFrame) -> int:
        """Take in documents; those whose idx is there already are replaced. Returns the corpus' version."""
        return self._corpus().ingest(docs)

    def delete(self, ids: DataFrame) -> int:
        """Take out the documents whose idx is in ``ids``."""
        return self._corpus().delete(ids)

    def index(self) -> int:
        """Write the corpus anew as one segment, without what is deleted. Answers stay the same."""
        return self._corpus().merge(everything=True)

    def _lexical(self, asked: DataFrame) -> LexicalIndex:
        """The index of the asked terms."""
        only = asked.select(F.explode("words").alias("term"))
        if self.corpus is None:
            return build_index(composed(self.docs, "law_name", "text"), "idx", self.words, only=only).kept()
        self.corpus.refresh()
        index = self.corpus.lexical(only)
        if index is None:
            raise RetrievalError("nothing has been ingested yet")
        self.docs, self.vectors = self.corpus.documents().drop("vec"), self.corpus.documents().select("idx", "vec")
        return index.kept()

    def accepted(self, queries: DataFrame, top_k: Column | None = None) -> DataFrame:
        """Queries (qid, query) within bounds: not blank, not too long, top_k in range."""
        fine = (F.trim("query") != "") & (F.length("query") <= self.params.max_query_chars)
        return queries.filter(fine & top_k.between(1, self.params.max_top_k) if top_k is not None else fine)

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """qid, query, rank, idx, scores and the document's columns for the top_k hits of every query."""
        p, top_k = self.params, top_k or self.params.final_k
        asked = composed(self.accepted(queries), "query").withColumn("words", tokens(F.col("query"), p.profile))
        index = self._lexical(asked)
        lexical = blockmax_topk(index, asked, p.bm25_candidates, k1=p.k1, b=p.b)
        if self.pad_zero:
            lexical = padded_top(lexical.drop("rank"), asked, index.lengths, p.bm25_candidates)
        dense = dense_topk(asked.select("qid", self.encoder("query").alias("vec")), self.vectors, p.dense_candidates)
        pool = hybrid_union(dense, lexical, p.rerank_candidates, key="idx")
        pool = pool.join(asked.select("qid", "query", "words"), "qid").join(self.docs, "idx")
        if self.reranker is None:
            return unfused(pool.withColumn("reranker_score", F.lit(None).cast("double")), top_k).drop("words")
        text = tokens(pair_text(F.col("law_name"), F.col("text"), p.rerank_max_chars), p.profile)
        return fused(pool.withColumn("reranker_score", self.reranker(F.col("words"), text)), top_k, p.alpha, key="document_id").drop("words")

    def answer(self, queries: DataFrame, backend: Backend | None = None, top_k: int | None = None) -> DataFrame:
        """qid, query, answer, citations, warnings, n_sources. Queries or contexts that give orders are refused."""
        p = self.params
        evidence = select_evidence(self.retrieve(queries, top_k), p.max_context_chars, p.min_score)
        contexts = grounded_context(evidence, p.max_context_chars)
        rows = queries.join(contexts, "qid", "left").select("qid", "query", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
        refused = has_injection(F.col("query")) | has_injection(F.col("context"))
        said = generated(rows.filter(~refused), backend or ExtractiveBackend()).withColumn("a", parsed_answer(F.col("raw_answer")))
        cited = said.select("qid", F.posexplode("a.citations").alias("position", "c")).select("qid", "position", F.coalesce("c.id", "c.source_id").alias("source_id"))
        odd = citation_warnings(cited, evidence).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "warning"))), lambda s: s["warning"]).alias("w"))
        none = F.expr("cast(array() as array<string>)")
        good = said.join(odd, "qid", "left").select("qid", "query", F.col("a.answer").alias("answer"), F.col("a.citations").alias("citations"), F.concat("a.warnings", F.coalesce("w", none)).alias("warnings"), "n_sources")
        kind = good.schema["citations"].dataType.simpleString()
        bad = rows.filter(refused).select("qid", "query", F.lit("").alias("answer"), F.expr(f"cast(array() as {kind})").alias("citations"), F.array(F.lit("possible prompt injection")).alias("warnings"), "n_sources")
        return good.unionByName(bad)

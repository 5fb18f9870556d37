"""A corpus and its lexical index that take in documents: immutable segments, tombstones, additive counts, merges by size.

Every change writes new tables and then one commit (:mod:`corpusloom.sources.commits`) that names them. An ingest is
a segment: its documents, its postings, and how many of its documents hold each term. A deletion is a table of ids that
hides them in all earlier segments, and the counts it takes away. A document that comes again replaces its earlier self.
So numbers of documents, lengths and document frequencies are sums of what the changes brought, and no change reads the
postings of documents it does not touch. Segments of one size class are merged when there are FAN of them, without what is
hidden; a merge changes neither counts nor answers. Readers keep the version they opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.lexical import MARK, LexicalIndex, build_index
from corpusloom.sources.commits import CommitLog

#: Segments of one size class that are merged; sizes of a class differ by this factor at most.
FAN = 8


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


class SegmentedCorpus:
    """Documents (column idx, whole numbers, and others) under ``root``; ``words`` is the array of a row's terms, ``extra``
    columns to be made once for each document (a vector), and ``prepare`` what texts go through before they are cut."""

    def __init__(
        self, spark: SparkSession, root: str, words: Column, extra: dict[str, Column] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, fan: int = FAN
    ):
        self.prepare = prepare or (lambda docs: docs)
        self.spark, self.root, self.words, self.extra, self.fan = spark, root.rstrip("/"), words, extra or {}, fan
        self.log = CommitLog(spark, f"{self.root}/commits", {"segments": [], "deletions": []})
        self.version, self.state = self.log.latest()

    def refresh(self) -> None:
        """Go on to the newest version."""
        self.version, self.state = self.log.latest()

    # reading

    def _live(self, name: str, state: dict, segments: list[dict] | None = None) -> DataFrame | None:
        """Rows of a table of all (or some) segments that no later deletion hides."""
        segments = state["segments"] if segments is None else segments
        if not segments:
            return None
        rows = together([self.spark.read.parquet(f"{s['path']}/{name}").withColumn("_seq", F.lit(s["seq"])) for s in segments])
        deletions = [d for d in state["deletions"] if any(s["seq"] < d["seq"] for s in segments)]
        if deletions:
            gone = together([self.spark.read.parquet(f"{d['path']}/ids").withColumn("_after", F.lit(d["seq"])) for d in deletions]).groupBy("idx").agg(F.max("_after").alias("_after"))
            rows = rows.alias("r").join(gone.alias("g"), F.expr("r.idx = g.idx AND r._seq < g._after"), "left_anti")
        return rows.drop("_seq")

    def documents(self) -> DataFrame | None:
        """The live documents with their extra columns; None before the first ingest."""
        return self._live("documents", self.state)

    def lexical(self, only: DataFrame | None = None) -> LexicalIndex | None:
        """The live postings, of the terms in ``only`` where it is given, with the counts of the whole corpus."""
        table = self._live("postings", self.state)
        if table is None:
            return None
        if only is not None:
            mark = self.spark.range(1).select(F.lit(MARK).alias("term"))
            table = table.join(only.select("term").distinct().unionByName(mark), "term", "left_semi")
        changes = self.state["segments"] + self.state["deletions"]
        terms = together([self.spark.read.parquet(f"{c['path']}/terms") for c in changes]).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        n, length = sum(c["documents"] for c in changes), sum(c["length"] for c in changes)
        return LexicalIndex(table, n, length / n if n else 0.0, terms)

    # changes

    def _counted(self, postings: DataFrame, path: str, sign: int) -> tuple[int, int]:
        """Write the frequencies of terms in ``postings``; (documents, length) with the sign."""
        terms = postings.filter(F.col("term") != MARK).groupBy("term").agg((F.count("*") * sign).alias("df"))
        terms.write.parquet(f"{path}/terms")
        n, length = postings.filter(F.col("term") == MARK).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return sign * n, sign * length

    def _segment(self, docs: DataFrame, seq: int) -> dict:
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        docs.select("*", *[c.alias(n) for n, c in self.extra.items()]).write.parquet(f"{path}/documents")
        held = self.spark.read.parquet(f"{path}/documents")
        build_index(self.prepare(held), "idx", self.words).table.sort("term").write.parquet(f"{path}/postings")
        n, length = self._counted(self.spark.read.parquet(f"{path}/postings"), path, 1)
        return {"path": path, "seq": seq, "documents": n, "length": length, "rows": n}

    def _deletion(self, ids: DataFrame, state: dict, seq: int) -> dict | None:
        """Hide ``ids`` in all segments there are; None if none of them is live."""
        held = self._live("postings", state)
        if held is None:
            return None
        path = f"{self.root}/deletions/{uuid.uuid4().hex}"
        marks = held.filter(F.col("term") == MARK).select("idx")
        ids.select(F.col("idx").cast("long").alias("idx")).filter("idx IS NOT NULL").distinct().join(marks, "idx", "left_semi").write.parquet(f"{path}/ids")
        gone = self.spark.read.parquet(f"{path}/ids")
        if gone.isEmpty():
            return None
        n, length = self._counted(held.join(gone, "idx", "left_semi"), path, -1)
        return {"path": path, "seq": seq, "documents": n, "length": length}

    def ingest(self, docs: DataFrame) -> int:
        """Take in the rows of ``docs``; of rows that repeat an idx one stays, rows with a null idx are left out. A document that
        is there already is replaced. Returns the version."""
        rows = docs.withColumn("idx", F.col("idx").cast("long")).filter("idx IS NOT NULL").dropDuplicates(["idx"])

        def change(version, state):
            fresh = self._segment(rows, version + 1)
            held = self.spark.read.parquet(f"{fresh['path']}/documents").select("idx")
            gone = self._deletion(held, state, version + 1)
            return {"segments": [*state["segments"], fresh], "deletions": [*state["deletions"], *([gone] if gone else [])]}

        self.version, self.state = self.log.update(change)
        return self.merge()

    def delete(self, ids: DataFrame) -> int:
        """Take out the documents whose idx is in ``ids``; others are not there already."""

        def change(version, state):
            gone = self._deletion(ids, state, version + 1)
            return {**state, "deletions": [*state["deletions"], *([gone] if gone else [])]}

        self.version, self.state = self.log.update(change)
        return self.version

    def merge(self, everything: bool = False) -> int:
        """Merge size classes with FAN segments or more, or all segments to one whose counts are those of its live rows."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in self.state["segments"]:
                size, tier = max(1, s["rows"]), 0
                while size >= self.fan:
                    size, tier = size // self.fan, tier + 1
                classes.setdefault(tier, []).append(s)
            some = self.state["segments"] if everything else next((c for c in classes.values() if len(c) >= self.fan), [])
            if len(some) < (1 if everything else 2):
                return self.version
            paths = {s["path"] for s in some}

            def change(version, state):
                mine = [s for s in state["segments"] if s["path"] in paths]  # noqa: B023
                if len(mine) < len(paths) or everything and len(mine) < len(state["segments"]):  # noqa: B023
                    return state  # another writer merged some of them, or added more
                path = f"{self.root}/segments/{uuid.uuid4().hex}"
                self._live("documents", state, mine).write.parquet(f"{path}/documents")
                self._live("postings", state, mine).sort("term").write.parquet(f"{path}/postings")
                rows = self.spark.read.parquet(f"{path}/documents").count()
                seq = max([s["seq"] for s in mine] + [d["seq"] for d in state["deletions"] if everything])
                if everything:
                    n, length = self._counted(self.spark.read.parquet(f"{path}/postings"), path, 1)
                    return {"segments": [{"path": path, "seq": seq, "documents": n, "length": length, "rows": rows}], "deletions": []}
                together([self.spark.read.parquet(f"{s['path']}/terms") for s in mine]).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/terms")
                one = {"path": path, "seq": seq, "documents": sum(s["documents"] for s in mine), "length": sum(s["length"] for s in mine), "rows": rows}
                return {**state, "segments": [*[s for s in state["segments"] if s["path"] not in paths], one]}  # noqa: B023

            self.version, self.state = self.log.update(change)
            if everything:
                return self.version

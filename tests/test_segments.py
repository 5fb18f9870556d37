import json
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.errors import CommitConflict, RetrievalError, SettingsError, UnknownVersion
from corpusloom.operators import knowledge
from corpusloom.operators.lexical import bm25_scores, build_index, top
from corpusloom.operators.segments import SegmentedCorpus
from corpusloom.plans.params import TEST
from corpusloom.plans.service import Service
from corpusloom.sources.commits import CommitLog

SCHEMA = "idx long, text string"
WORDS = lambda: F.split("text", " ")


def answers(index, queries):
    return {(r.qid, r["rank"], r.idx, r.score) for r in top(bm25_scores(index, queries), 5).collect()}


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_changes_answers_like_a_fresh_index(spark, tmp_path, seed):
    rng = random.Random(seed)
    corpus, model = SegmentedCorpus(spark, f"file://{tmp_path}/c", WORDS(), fan=2), {}
    queries = spark.createDataFrame([(i, [f"w{rng.randint(0, 12)}" for _ in range(4)]) for i in range(6)], "qid long, words array<string>")
    text = lambda: " ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.randint(1, 9)))
    assert corpus.lexical() is None and corpus.documents() is None
    for step in ("ingest", "ingest", "delete", "ingest", "merge", "delete", "ingest"):
        if step == "ingest":
            rows = {rng.randint(0, 60): text() for _ in range(20)}
            corpus.ingest(spark.createDataFrame(list(rows.items()) + [(None, "w1")], SCHEMA))
            model |= rows
        elif step == "delete":
            ids = [rng.randint(0, 60) for _ in range(9)]
            corpus.delete(spark.createDataFrame([(i,) for i in [*ids, 999]], "idx long"))
            model = {i: t for i, t in model.items() if i not in ids}
        else:
            corpus.merge(everything=True)
            assert len(corpus.state["segments"]) == 1 and not corpus.state["deletions"]
    assert {(r.idx, r.text) for r in corpus.documents().collect()} == set(model.items())
    fresh = build_index(spark.createDataFrame(list(model.items()), SCHEMA), "idx", WORDS())
    mine = SegmentedCorpus(spark, f"file://{tmp_path}/c", WORDS()).lexical()  # another reader of the same folder
    assert {(r.term, r.df) for r in mine.terms().collect()} == {(r.term, r.df) for r in fresh.terms().collect()}
    assert mine.stats().first() == fresh.stats().first() and answers(mine, queries) == answers(fresh, queries)


def test_merging_keeps_later_deletions_and_returned_documents(spark, tmp_path):
    corpus = SegmentedCorpus(spark, f"file://{tmp_path}/c", WORDS(), fan=2)
    one = lambda i, t: spark.createDataFrame([(i, t)], SCHEMA)
    corpus.ingest(one(1, "a b"))
    corpus.delete(one(1, "").select("idx"))
    corpus.ingest(one(1, "c"))  # merged with the first, which is deleted
    assert len(corpus.state["segments"]) == 1
    assert [tuple(r) for r in corpus.documents().collect()] == [(1, "c")]
    old = SegmentedCorpus(spark, f"file://{tmp_path}/c", WORDS(), fan=2)
    corpus.delete(one(1, "").select("idx"))
    assert corpus.documents().count() == 0 and corpus.lexical().stats().first().n == 0
    assert old.documents().count() == 1  # a reader keeps its version
    old.refresh()
    assert old.documents().count() == 0


def test_service_over_a_folder(spark, tmp_path):
    texts = ["theft is punished by law.", "a contract binds its parties.", "costs follow the event."]
    docs = spark.createDataFrame([(i, f"d{i}", "Act", str(i), t) for i, t in enumerate(texts)], "idx long, document_id string, law_name string, article_id string, text string")
    queries = spark.createDataFrame([(1, "which contract binds"), (2, "costs of theft")], "qid long, query string")
    service = Service(params=TEST, root=f"file://{tmp_path}/c")
    with pytest.raises(RetrievalError):
        service.retrieve(queries)
    service.ingest(docs.filter("idx < 2"))
    service.ingest(docs.filter("idx = 2"))
    columns = ["qid", "rank", "idx", "final_score", "document_id", "text"]
    rows = lambda s: sorted(map(tuple, s.retrieve(queries).select(columns).collect()))
    want = rows(Service(docs, TEST))
    assert rows(service) == want
    service.ingest(docs.filter("idx = 1").withColumn("text", F.lit("other words")))
    service.delete(docs.filter("idx = 0").select("idx"))
    service.index()
    rest = docs.filter("idx > 0").withColumn("text", F.when(F.col("idx") == 1, "other words").otherwise(F.col("text")))
    assert rows(service) == rows(Service(rest, TEST))
    with pytest.raises(RetrievalError):
        Service(docs, TEST).ingest(docs)
    with pytest.raises(SettingsError):
        Service()


def test_one_of_two_writers_wins(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", {"n": 0})
    assert log.latest() == (0, {"n": 0})
    assert log.commit(0, {"n": 1}) == 1
    with pytest.raises(CommitConflict):
        log.commit(0, {"n": 7})
    assert log.latest() == (1, {"n": 1})
    found = []

    def add():
        for _ in range(5):
            CommitLog(spark, f"file://{tmp_path}/log").update(lambda v, s: {"n": s["n"] + 1}, tries=200)
            found.append(CommitLog(spark, f"file://{tmp_path}/log").latest()[1]["n"])

    threads = [threading.Thread(target=add) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert log.latest() == (21, {"n": 21}) and len(found) == 20
    # a file that is not whole yet belongs to a writer at work
    Path(tmp_path, "log", "00000022.json").write_text(json.dumps({"n": 99})[:4])
    assert log.latest() == (21, {"n": 21}) and log.read(22) is None
    with pytest.raises(CommitConflict):
        log.update(lambda v, s: s, tries=2)


def test_pointer_of_versions(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    with pytest.raises(UnknownVersion):
        knowledge.current_version(spark, root)
    for v in ("v1", "v2"):
        knowledge.save_version(spark, knowledge.KnowledgeVersion(v, "h", 1, "m"), root)
        knowledge.make_current(spark, root, v)
    assert knowledge.current_version(spark, root) == "v2"
    knowledge.make_current(spark, root, "v1")
    assert knowledge.current_version(spark, root) == "v1"

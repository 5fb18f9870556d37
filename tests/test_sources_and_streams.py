import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.models import hashed_encoder
from corpusloom.operators import ingest, knowledge
from corpusloom.operators.keeping import kept, let_go
from corpusloom.sources import files
from corpusloom.streaming.ingest import ingest_stream
from corpusloom.streaming.limits import limited, limited_stream, step


def test_corpus_files(spark, tmp_path):
    docs = [{c: "x" for c in ingest.REQUIRED} | {"document_id": str(i), "raw_text": t} for i, t in enumerate(["نص", " ", None])]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(docs, ensure_ascii=False, indent=2))
    df = files.first_corpus(spark, [str(tmp_path / "none.json"), str(path)])
    assert [r.is_valid for r in ingest.validated(df).orderBy("document_id").collect()] == [True, False, False]
    with pytest.raises(ingest.InvalidDocument, match="document 1: text is blank"):
        ingest.require_valid(ingest.numbered(df, "document_id"))
    assert files.first_corpus(spark, [str(tmp_path / "none.json")]).count() == 3
    assert "missing" in ingest.first_invalid(df.drop("law_id").withColumn("idx", F.lit(0))).first().reason
    with pytest.raises(FileNotFoundError):
        files.read_report(spark, str(tmp_path / "none"))
    assert files.file_digests(spark, str(tmp_path), "*.json").count() == 1


def test_settings():
    got = files.settings({"top_k": 5, "alpha": 0.75, "on": False}, "retrieval:\n  top_k: 7\nalpha: 0.5\n", 'ALPHA="0.25"\n# no\n', {"ON": "true"})
    assert got == {"top_k": 7, "alpha": 0.25, "on": True}


def test_lists_in_yaml():
    got = files.parse_flat_yaml("paths:\n  corpora:\n    - a.json\n    - 'b.json'  # second\n  depth: 2\ncuts:\n- 1\n- 3\n# end\nname: x: y\n")
    assert got == {"paths.corpora": ["a.json", "b.json"], "paths.depth": 2, "cuts": [1, 3], "name": "x: y"}


def test_rolled_back_artifacts(spark, tmp_path):
    root = str(tmp_path)
    for i in (1, 2):
        knowledge.save_version(spark, knowledge.KnowledgeVersion(f"v{i}", "h", i, "m"), root)
        knowledge.save_artifact(spark.createDataFrame([(i,)], "x long"), root, f"v{i}", "vectors")
    for current in ("v2", "v1"):
        knowledge.make_current(spark, root, current)
        assert [r.x for r in knowledge.read_artifact(spark, root, "vectors").collect()] == [int(current[1])]
    assert knowledge.read_artifact(spark, root, "vectors", "v2").first().x == 2


def test_digest_of_several_levels(spark):
    docs = spark.range(100).withColumnRenamed("id", "n")
    part = F.col("n").cast("string")
    level = [hashlib.sha256("|".join(map(str, range(a, min(a + 4, 100)))).encode()).hexdigest() for a in range(0, 100, 4)]
    while len(level) > 4:
        level = [hashlib.sha256("|".join(level[a : a + 4]).encode()).hexdigest() for a in range(0, len(level), 4)]
    want = hashlib.sha256("|".join(level).encode()).hexdigest()
    assert ingest.tree_digest(docs, "n", part, fan=4).first().corpus_hash == want
    assert ingest.tree_digest(docs.limit(0), "n", part).count() == 1


def test_kept_tables_let_the_last_one_go(spark):
    first = kept(spark.range(5), "test")
    assert first.count() == 5 and first.is_cached
    second = kept(spark.range(6), "test")
    assert not first.is_cached and second.is_cached and first.count() == 5
    let_go("test")
    assert not second.is_cached


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    for i in (1, 2):
        knowledge.save_version(spark, knowledge.KnowledgeVersion(f"v{i}", "h", i, "m"), root)
    assert [r.version_id for r in knowledge.list_versions(spark, root).collect()] == ["v1", "v2"]
    knowledge.make_current(spark, root, "v2")
    knowledge.make_current(spark, root, "v1")
    assert knowledge.current_version(spark, root) == "v1"
    with pytest.raises(ValueError):
        knowledge.make_current(spark, root, "v9")


def test_cache(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, t string")
    empty = spark.createDataFrame([], "doc_hash string, embedding array<float>")
    vectors, full = knowledge.cached_embeddings(docs, empty, hashed_encoder(8), "t", "id")
    assert full.count() == 3 and vectors.filter("embedding is not null").count() == 4
    assert knowledge.cache_misses(docs, full, "t", "id").count() == 0


def test_limits(spark):
    times = [0, 1, 2, 60, 61, 62, 200]
    want, state = [], (None, 0)
    for t in times:
        *state, rejected = step(*state, t, 60, 2)
        want.append(rejected)
    assert want == [False, False, True, True, False, False, False]
    events = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [(None, 99, 5)], "k string, t long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = limited(events, "k", "ts", "t", 60, 2)
    assert [r.rejected for r in got.filter("k = 'a'").orderBy("t").collect()] == want and got.count() == 8


def test_limit_stream(spark, tmp_path):
    events = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 9, 3)], "k string, t long, s long").withColumn("ts", F.timestamp_seconds("s"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = limited_stream(source, "k", "ts", "t", 60, 2).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted((r.k, r.t, r.rejected) for r in spark.table("limits").collect()) == [("a", 0, False), ("a", 1, False), ("a", 2, True), ("a", 3, True), ("a", 4, True), ("b", 9, False)]


def test_ingest_stream(spark, tmp_path):
    staging, table = str(tmp_path / "staging"), str(tmp_path / "table")
    row = lambda i, t: tuple([str(i), "j", "l", "n", "a", t, t, t, None, None])
    files.write_staged(spark.createDataFrame([row(1, "one"), row(2, "one"), row(3, " ")], files.CORPUS), staging)
    ingest_stream(spark, staging, table, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(table).count() == 1
    files.write_staged(spark.createDataFrame([row(4, "two"), row(5, "one")], files.CORPUS), staging)
    ingest_stream(spark, staging, table, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.raw_text for r in spark.read.parquet(table).collect()) == ["one", "two"]

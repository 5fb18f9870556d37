import pytest

import corpus_pipeline
from corpusloom.llm import queries as llm
from tests.conftest import rows_of
from tests.llm.helpers import EN, SCHEMA, awkward, empty


def nullable(frame):
    """Whole numbers with gaps as such, in both frames."""
    gaps = [c for c in frame.columns if frame[c].isna().any() and frame[c].dtype.kind in "fiu" and not (frame[c].dropna() % 1).any()]
    return frame.astype({c: "Int64" for c in gaps})


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_duckdb(name, spark, duck, small):
    got, want = llm.queries()[name](spark, small).toPandas(), duck.sql(llm.oracle_sql()[name]).df()
    assert rows_of(nullable(got)) == rows_of(nullable(want))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql()) - {"op10_spaced_seed_decontamination"}))
def test_covers_the_table(name, spark, duck, small):
    got = llm.queries()[name](spark, small).toPandas()
    assert set(got.doc_id) == set(duck.sql("SELECT doc_id FROM documents").df().doc_id)


def test_finds_every_passage(spark, duck, small):
    got = {(r.doc_id, i) for r in llm.queries()["op10_spaced_seed_decontamination"](spark, small).collect() for i in r["items"].split(",")}
    held = duck.sql("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall()
    assert held and {(d, str(i)) for d, i in held} <= got and len(got) < 2 * len(held)


def test_stages_on_awkward_rows(spark, tmp_path):
    bench = spark.createDataFrame([(1, "only a benchmark passage that no document holds at all here")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    long = [(30, "same " * 60_000, "en"), (31, "a " * 90_000 + EN, None), (32, " ".join(f"word{i % 997}x{i % 61}" for i in range(40_000)), "en")]
    df = awkward(spark).unionByName(spark.createDataFrame(long, "doc_id long, text string, lang string"), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert 0 < out.count() <= df.count(), name
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.packing(spark, df, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna()) == {r.doc_id for r in df.collect() if r.doc_id is not None} and packed.doc_id.isna().sum() == 1
    filled = packed.groupby("sequence_id").length.sum()
    assert filled.max() <= 1024 and (packed[packed.doc_id == 12].groupby("doc_id").size() == 2).all()
    assert corpus_pipeline.packing(spark, empty(spark), str(tmp_path)).count() == 0


def test_stages_decide(spark, tmp_path):
    passage = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    body = " ".join(f"word{i}" for i in range(120))
    rows = [(1, body + " end", "en"), (2, body + " other end", "en"), (3, f"{EN} {passage}", "en"), (4, "!!! 123", None), (5, "completely different text about ships and harbours", "en")]
    spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == {1, 5}

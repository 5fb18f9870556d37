import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm.cuckoo import CuckooFilter
from corpusloom.llm.line_dedup import LineIndex, strip_shared_lines
from corpusloom.llm.sharding import shard_by_bytes
from tests.llm.helpers import awkward, empty


def shards(spark, df, **options):
    return shard_by_bytes(spark, df, **options).toPandas()


def test_shards_of_awkward_rows(spark):
    df = awkward(spark)
    got = shards(spark, df, shards=3)
    assert len(got) == df.count() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by_id = got[got.doc_id == 3].iloc[0]
    assert by_id["size"] == 1 and by_id["text_crc32"] == 0
    assert got[got.doc_id == 7].text_crc32.iloc[0] == zlib.crc32(df.filter("doc_id = 7").first().text.encode())
    assert len(shards(spark, empty(spark))) == 0


def test_hot_text_is_split_and_shards_are_even(spark):
    rows = [(i, "same text" if i % 2 else f"text {i} " * (i % 7)) for i in range(4000)]
    got = shards(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=8)
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() < 0.01 * total.mean() + 200
    hot = got[got.text_crc32 == zlib.crc32(b"same text")]
    assert hot.shard.nunique() > 1
    same = shards(spark, spark.createDataFrame([(1, "copy")] * 64, "doc_id long, text string"), shards=8)
    assert same.groupby("shard").size().tolist() == [8] * 8


def test_rows_without_text_are_cut_by_rows(spark, monkeypatch):
    """Nine of ten texts are null: the shard that holds them is cut into pieces of PIECE_ROWS rows, about."""
    from corpusloom.llm import sharding

    monkeypatch.setattr(sharding, "PIECE_ROWS", 1000)
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("word "), 200)).alias("text"))
    out = shard_by_bytes(spark, df, shards=4)
    got = out.toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 4 and total.max() - total.min() < 0.01 * total.mean() + 1100
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    keyed = df.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_row"), F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"))
    cuts, shard, _ = sharding.ranges_of(spark, keyed, 4, 0.002)
    rows = [g[1] for g in sharding.count_between(keyed, cuts)]
    assert max(rows) < 2000 and sum(rows) == 30_000 and (np.diff(shard) >= 0).all() and set(shard) == {0, 1, 2, 3}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=300))
def test_cuckoo_filter(items):
    x = np.array(items, np.int64)
    f = CuckooFilter.from_bytes(CuckooFilter.build(x).to_bytes())
    assert f.contains(x).all() and f.count == len(x)
    half = x[::2]
    assert f.delete(half).all() and f.contains(x[1::2]).all()
    assert (f.table != 0).sum() == len(x) - len(half)


def test_cuckoo_filter_is_selective():
    rng = np.random.default_rng(1)
    f = CuckooFilter.build(rng.integers(-(2**62), 2**62, 50_000))
    assert f.contains(rng.integers(-(2**62), 2**62, 50_000)).mean() < 0.01


def brute(rows, least=10):
    """The contract, row by row: {doc_id: (lines, dropped, hash)} for rows with distinct ids."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def result(spark, index, df):
    return {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in strip_shared_lines(index, df).collect()}


def test_lines_against_brute_force(spark):
    df = awkward(spark, repeated=False)
    index = LineIndex(spark)
    index.insert(df)
    assert result(spark, index, df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_lines_of_repeated_and_null_ids(spark):
    df = awkward(spark)
    index = LineIndex(spark)
    index.insert(df)
    assert strip_shared_lines(index, df).count() == df.count()
    none = LineIndex(spark)
    none.insert(empty(spark))
    assert strip_shared_lines(none, empty(spark)).count() == 0
    assert strip_shared_lines(none, df).filter("n_dropped > 0").count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rows = [(i, f"line number {i % 5} of all\nshort\nonly in {i} and nowhere") for i in range(20)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    index = LineIndex(spark)
    index.insert(frame(rows[8:]))
    index.insert(frame(rows[:8]))
    assert result(spark, index, frame(rows)) == brute(rows)
    gone = [0, 1, 2, 5, 10, 15, 6]
    index.delete(frame([(i, "") for i in gone]).select("doc_id"))
    left = [r for r in rows if r[0] not in gone]
    assert result(spark, index, frame(left)) == brute(left)
    held = {r.k2 for r in index.shared.select("k2").collect()}
    filters = [CuckooFilter.from_bytes(bytes(r.filter)) for r in index.filters.collect()]
    assert sum(f.count for f in filters) == len(held)
    index.insert(frame([r for r in rows if r[0] in gone]))
    assert result(spark, index, frame(rows)) == brute(rows)


def test_full_shards_are_built_anew(spark):
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    first = [(i, "the only shared line") for i in range(3)]
    second = [(10 + i, "\n".join(f"shared line number {j}" for j in range(80))) for i in range(3)]
    index = LineIndex(spark)
    index.insert(frame(first))
    index.insert(frame(second))
    assert result(spark, index, frame(first + second)) == brute(first + second)
    assert sum(CuckooFilter.from_bytes(bytes(r.filter)).count for r in index.filters.collect()) == 81


def test_many_small_shards_and_cells(spark, monkeypatch):
    """The same results whatever the sizes of shards and cells, one of them hot; no filter is sent to all tasks."""
    monkeypatch.setattr("corpusloom.llm.line_dedup.KEYS_PER_SHARD", 8)
    monkeypatch.setattr("corpusloom.llm.line_dedup.REFS_PER_CELL", 16)
    rows = [(i, "\n".join(["the line that every document holds", f"line number {i % 40} of all", f"only in {i} and nowhere"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex(spark)
    index.insert(df)
    assert index.shards == 6 and index.filters.count() <= 6
    assert result(spark, index, df) == brute(rows)
    held = {(r.k1, r.k2) for r in index.shared.collect()}
    found = [(r.k1, r.k2) for r in index.candidates().collect()]
    assert set(found) >= held and len(set(found)) < 60
    assert "BroadcastExchange" not in index.candidates().select("k1")._jdf.queryExecution().toString().split("FlatMapCoGroups")[0]


def test_null_ids_take_no_part_in_lines(spark):
    line = "one line that many rows hold"
    df = spark.createDataFrame([(None, line), (2**63 - 1, line), (None, f"{line}\n{line}"), (-(2**63), line), (0, line + " 0")], "doc_id long, text string")
    index = LineIndex(spark)
    index.insert(df)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped) for r in strip_shared_lines(index, df).collect())
    assert got == [(False, -(2**63), 1, 0), (False, 0, 1, 0), (False, 2**63 - 1, 1, 1), (True, 0, 1, 0), (True, 0, 2, 0)]
    alone = LineIndex(spark)
    alone.insert(df.filter("doc_id > 0 or doc_id is null"))
    assert alone.size == 0


def test_changes_are_compacted(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.line_dedup.COMPACT", 3)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    rows = [(i, f"line number {i % 3} of all\nline number {i % 4} of others") for i in range(24)]
    index = LineIndex(spark)
    for at in range(0, 24, 6):
        index.insert(frame(rows[at : at + 6]))
    index.delete(frame(rows[:2]).select("doc_id"))
    index.delete(frame(rows[:3]).select("doc_id"))
    index.insert(frame(rows[:1]))
    left = rows[:1] + rows[3:]
    assert index.changes == 6 and len(index.tables) == 2
    assert result(spark, index, frame(left)) == brute(left)


def test_kept_columns_with_names_of_the_result(spark):
    df = awkward(spark)
    index = LineIndex(spark)
    index.insert(df)
    out = strip_shared_lines(index, df, keep=["_text", "_id", "keys"])
    assert out.columns == ["doc_id", "_text", "_id", "keys", "n_lines", "n_dropped", "kept"]
    assert {(r._text, r._id, r["keys"]) for r in out.collect()} == {("x", "x", "x")}
    with pytest.raises(ValueError, match="kept"):
        strip_shared_lines(index, df, keep=["kept"])


def test_ids_beside_nulls_stay_whole(spark):
    """Ids beyond 2^53 and the extreme ones, with nulls among them, in every operator that returns ids."""
    ids = [None, 2**63 - 1, -(2**63), 2**53 + 1, 2**62 + 3, None, 5]
    df = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = shard_by_bytes(spark, df, shards=2).collect()
    key = lambda x: (x is not None, x or 0)
    assert sorted([r.doc_id for r in got], key=key) == sorted(ids, key=key)
    by_crc = {zlib.crc32(f"text {i}".encode()): x for i, x in enumerate(ids)}
    assert all(by_crc[r.text_crc32] == r.doc_id for r in got)


def test_shards_against_brute_force(spark):
    """Every boundary is where the order says: all rows of a shard come before all rows of the next one, slots follow."""
    rows = [(i // 2 if i % 5 else None, f"text {i % 700} " * (1 + i % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {(r.text): r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    names = {zlib.crc32(t.encode()): t for t in hashes}
    got = sorted((r.shard, r.slot, hashes[names[r.text_crc32]], -(2**63) if r.doc_id is None else r.doc_id, r["size"]) for r in shard_by_bytes(spark, df, shards=5).collect())
    assert [g[2:4] for g in got] == sorted(g[2:4] for g in got)
    assert sorted(g[3] for g in got) == sorted(-(2**63) if i is None else i for i, _ in rows)
    total = sum(len(t) + 1 for _, t in rows)
    sizes = [sum(g[4] for g in got if g[0] == s) for s in range(5)]
    assert sum(sizes) == total and max(abs(x - total / 5) for x in sizes) <= 2 * (0.002 * total / 5 + max(len(t) + 1 for _, t in rows))
    for s in range(5):
        assert [g[1] for g in got if g[0] == s] == list(range(sum(g[0] == s for g in got)))


def test_plans_outlive_changes(spark, monkeypatch):
    """A result asked for before a deletion, an insertion and a compaction gives what it was; after vacuum the new ones stay."""
    from corpusloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "COMPACT", 2)
    rows = [(1, "a shared line of text\none"), (2, "a shared line of text\ntwo"), (3, "a shared line of text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex(spark)
    index.insert(df)
    before, want = strip_shared_lines(index, df), brute(rows)
    index.delete(df.filter("doc_id = 1").select("doc_id"))
    index.insert(spark.createDataFrame([(4, "a shared line of text\nfour")], "doc_id long, text string"))
    index.delete(df.filter("doc_id = 2").select("doc_id"))
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in before.collect()} == want
    assert index.retired
    index.vacuum()
    rest = spark.createDataFrame([rows[2], (4, "a shared line of text\nfour")], "doc_id long, text string")
    assert result(spark, index, rest) == brute([(r.doc_id, r.text) for r in rest.collect()])
    index.close()
    assert not index.tables and index.refs is None

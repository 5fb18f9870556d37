import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm.periods import Extensions, collapsed, longest_run, periodic_runs, runs_of
from tests.llm.helpers import awkward, empty


def brute(w, exponent, least):
    """Rows (start, period, length): of each period the stretches that keep it, once a stretch."""
    n, best = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                best.setdefault((i, j + p), p)
            i = j
    return sorted((s, p, e - s) for (s, e), p in best.items())


def rows(runs):
    return [(int(s), int(p), int(n)) for s, n, p in runs]


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.choice([0, 1, 3, 8, 20, 50, 120]))]
            if w and rng.random() < 0.5:
                w = w + w[: rng.randint(1, min(9, len(w)))] * rng.randint(2, 9) + w[:3]
            docs.append(w)
        for exponent, least in ((4, 6), (2, 2), (3, 10)):
            for d, (_, got) in zip(docs, runs_of([" ".join(d).encode() for d in docs], exponent, least)):
                assert rows(got) == brute(d, exponent, least), d


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=200), st.data())
def test_extensions(ids, data):
    x = np.array(ids, np.int64)
    a, b = (np.array(v, np.int64) for v in zip(*[data.draw(st.lists(st.integers(0, len(x) - 1), min_size=2, max_size=2, unique=True)) for _ in range(20)]))
    for i, j, got in zip(a, b, Extensions(x).forward(a, b)):
        k = 0
        while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        assert got == k


def test_small_blocks(monkeypatch):
    """Grids cut into many blocks, one period's points too, find the same runs."""
    from corpusloom.llm import periods

    text = ("a " * 300 + "b c " * 80 + "d e f " * 9).encode()
    want = runs_of([text], 4, 6)[0][1].tolist()
    monkeypatch.setattr(periods, "POINTS", 7)
    assert want == [[0, 300, 1], [300, 160, 2], [460, 27, 3]] and runs_of([text], 4, 6)[0][1].tolist() == want


def test_a_long_text_of_one_word():
    words, runs = runs_of([b"same " * 200_000], 4, 6)[0]
    assert runs.tolist() == [[0, 200_000, 1]] and collapsed(words, runs) == b"same"


def test_awkward_rows(spark):
    df = awkward(spark).unionByName(spark.createDataFrame([(20, "na " * 6 + "x", None), (21, "na " * 5 + "x", None), (22, "1 2 " * 4 + "q " * 8, "en")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = periodic_runs(spark, df, keep=["lang", "text"]).withColumn("r", longest_run())
    assert got.columns == ["doc_id", "lang", "text", "n_words", "runs", "collapsed", "r"] and got.count() == df.count()
    for r in got.collect():
        w = (r.text or "").split()
        assert r.n_words == len(w) and rows(r.runs) == brute(w, 4, 6)
        if not r.runs:
            assert r.r is None and bytes(r.collapsed).decode() == " ".join(w)
    by_id = {r.doc_id: r for r in got.collect()}
    assert bytes(by_id[20].collapsed) == b"na x" and by_id[20].r.length == 6 and not by_id[21].runs
    assert [tuple(x) for x in by_id[22].runs] == [(0, 8, 2), (8, 8, 1)] and tuple(by_id[22].r) == (0, 8, 2)
    assert periodic_runs(spark, empty(spark)).count() == 0


def test_planted_periods(spark):
    from corpusloom.llm.queries import crc_of, planted_periods

    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(400)] + [(None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r for r in planted_periods(df).join(df.select("doc_id", F.col("text").alias("old"), crc_of("doc_id").alias("h")), "doc_id").collect()}
    for r in got.values():
        w, n, g = r.old.split(), len(r.old.split()), r.h // 10
        if r.h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.text.split() == w
    assert sum(r.text != r.old for r in got.values()) > 10


def test_digest_of_runs(spark, small):
    """The query's digests are those of the operator's runs."""
    from corpusloom.llm.queries import op13_harmonic_periods, planted_periods

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in op13_harmonic_periods(spark, small).collect()}
    for r in planted_periods(docs).collect():
        w = r.text.split()
        runs = brute(w, 4, 6)
        lines = "".join(f"{s},{n},{p}\n" for s, p, n in runs)
        assert got[r.doc_id].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and got[r.doc_id].n_runs == len(runs)

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import substrings
from corpusloom.llm.substrings import Hasher, Words, remove_repeats
from tests.llm.helpers import EN, awkward, empty

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    """{doc_id: (kept, removed)} of rows with distinct ids; a null id keeps everything."""
    first, texts = {}, {i: (t or "").split() for i, t in rows}
    for i in sorted(k for k in texts if k is not None):
        for at in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][at : at + window]), (i, at))
    out = {}
    for i, words in texts.items():
        gone = set()
        for at in range(len(words) - window + 1):
            if i is not None and first[tuple(words[at : at + window])] != (i, at):
                gone.update(range(at, at + window))
        out[i] = (" ".join(w for j, w in enumerate(words) if j not in gone), len(gone))
    return out


def result(out):
    return {r.doc_id: (bytes(r.kept).decode(), r.n_removed) for r in out.collect()}


def check_repeats(rows, out, window):
    """Every repeat is one, cannot be made longer, and together they cover what was removed."""
    texts = {i: (t or "").split() for i, t in rows}
    for r in out.collect():
        covered = set()
        for start, end, doc, at in r.repeats:
            a, b, n = texts[r.doc_id], texts[doc], end - start
            assert n >= window and a[start:end] == b[at : at + n] and (doc, at) < (r.doc_id, start)
            covered.update(range(start, end))
        assert len(covered) == r.n_removed and r.n_words == len(texts[r.doc_id])


@pytest.mark.parametrize("window,anchor", [(5, 2), (4, 4), (6, 3), (20, 8), (1, 1)])
def test_against_brute_force(spark, window, anchor):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(["x", "y", "z", str(i)]) for _ in range(rng.randint(0, 2 * window))]
        rows.append((i * 7 % 120, " \t".join(words) if i % 11 else None))
    rows += [(500, "a " * 60), (501, "a " * 61 + "b " * 40), (502, "b " * 45), (503, "a b " * 40), (None, "a " * 70)]
    out = remove_repeats(spark, spark.createDataFrame(rows, SCHEMA), window=window, anchor=anchor)
    assert result(out) == brute(rows, window)
    check_repeats(rows, out, window)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"ab", b"ba", b"\xc3\xa9", b"x" * 300, b" ", b"\n\t", b"\x0b", b"\x1c", b"\xc2\xa0"]), max_size=25).map(b"".join), max_size=6), st.sampled_from([1, 5, 1 << 20]))
def test_hashes_of_words(texts, block):
    """As many words as split() gives, equal hashes for equal words wherever they stand, others for others."""
    old, substrings.BLOCK_BYTES = substrings.BLOCK_BYTES, block
    length, h = Hasher().of(texts)
    substrings.BLOCK_BYTES = old
    words = [w for t in texts for w in t.split()]
    assert length.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


def test_anchors_depend_on_their_window_alone():
    rng = random.Random(3)
    words = [rng.choice("abcd").encode() for _ in range(400)]
    whole = Words([b" ".join(words)], 7, 3, Hasher())
    of = {p - o: p for p, lo, hi in zip(whole.place.tolist(), whole.low.tolist(), whole.high.tolist()) for o in range(lo, hi + 1)}
    assert sorted(of) == list(range(394))
    for at in range(394):
        own = Words([b"q " + b" ".join(words[at : at + 7])], 7, 3, Hasher())
        assert of[at] - at in {p - 1 for p, lo, hi in zip(own.place.tolist(), own.low.tolist(), own.high.tolist()) if lo <= p - 1 <= hi}


def test_maximal_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one {passage} end"), (2, f"start of two {passage} more {passage}"), (3, " ".join(f"w{i}" for i in range(30)) + " cut " + " ".join(f"w{i}" for i in range(20, 45)))]
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in remove_repeats(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [(3, 63, 1, 1), (64, 124, 1, 1)], 3: [(0, 30, 1, 1), (31, 56, 1, 21)]}


def test_hot_passage_and_copies(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"l{i} l{i}b {passage} r{i} r{i}b" if i % 3 else f"{EN} {EN} again") for i in range(1, 300)]
    out = remove_repeats(spark, spark.createDataFrame(rows, SCHEMA))
    assert result(out) == brute(rows, 20)
    check_repeats(rows, out, 20)


def test_awkward_rows(spark):
    df = awkward(spark)
    out = remove_repeats(spark, df, window=6, anchor=3, keep=["lang", "shard"])
    assert out.columns == ["doc_id", "lang", "shard", "n_words", "n_removed", "kept", "repeats"] and out.count() == df.count()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add((bytes(r.kept).decode(), r.n_removed))
    want = brute([(r.doc_id, r.text) for r in df.collect()], 6)
    assert got == {i: {v} for i, v in want.items()}  # rows that repeat an id are equal here
    assert remove_repeats(spark, empty(spark)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark, df, keep=["kept"])


def test_rows_that_repeat_an_id(spark):
    """Different texts of one id are ordered by their hashes: one of them keeps the words, the other loses them."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, f"x {text}"), (2, text)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got in ([(1, 30, 0), (1, 30, 0), (1, 31, 30), (2, 30, 30)], [(1, 30, 30), (1, 30, 30), (1, 31, 0), (2, 30, 30)])


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, EN)], SCHEMA).select("*", *[F.lit(7).alias(c) for c in ("_doc", "_row", "_ranges", "_text", "list", "a")])
    out = remove_repeats(spark, df, keep=["_doc", "_row", "_ranges", "_text", "a"]).first()
    assert out._doc == out._row == out._ranges == out._text == out.a == 7 and out.n_removed == 0

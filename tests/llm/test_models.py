import hashlib
import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_pipeline import language_id
from corpusloom.llm import classifiers, pii
from corpusloom.llm.bytecnn import WIDTHS, WINDOW, ByteCnn, windows_of
from corpusloom.llm.common import written
from tests.llm.helpers import DE, EN, SCHEMA, awkward, empty

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(number))) % 10 == 0


def brute_base(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"), "card": 14 <= len(number) <= 19 and luhn(number), "phone": 10 <= len(number) <= 15}[kind]
            if fine:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


TEXTS = [
    "a@b.c_d@e.f x@y.z. a@b", "1.2.3.4.5.6.7.8 300.1.1.1 00255.1.2.3", "+1 (366) 555-9807. +12", "é 😀 z@q.io 4111 1111 1111 1111", "9" * 3000, "4111111111111111 " * 700,
    "", None, "+1234567890(((+1 234 567 8901", "a" * 50_000 + " 1", "a@" + "b" * 2000 + ".c" + ".d" * 9000, "no data at all", "1.1.1.1 " * 600 + "é x@y.zz",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(spark, df).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].base == brute_base(t)
        assert set(got[i].base.split(",")) <= set(got[i].spans.split(","))


def test_added_spans(spark):
    rows = [(i, f"words password={hashlib.md5(str(i).encode()).hexdigest()} more words") for i in range(40)]
    rows += [(100 + i, f"https://example.org/a-path/of-words/page-{i}/index") for i in range(40)] + [(200 + i, f"call (415) 555-{1000 + i} now") for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    assert all(got[i] == "secret:15:47" for i in range(40)) and all(got[100 + i] == "" for i in range(40)) and all(got[200 + i] == "phone:5:19" for i in range(20))


def planted(i):
    """(kind, text, span) of a planted case; kind None: nothing personal."""
    rng = np.random.default_rng(i)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    bban = digit(18)
    check = 98 - int(bban + "131400") % 97  # D and E are 13 and 14
    cases = [
        ("secret", "the token = \"{}\" was", hashlib.sha1(str(i).encode()).hexdigest()),
        ("iban", "pay to account {} today", f"DE{check:02d}{bban}"),
        (None, "order number {} has", f"DE{(check + 40) % 97:02d}{bban}"),
        ("street", "she lives at {} since then", f"{1 + i} North Harbour {('Street', 'Road', 'Avenue')[i % 3]}"),
        ("name", "signed by {}, who", f"{('Mr', 'Mrs', 'Dr.')[i % 3]} {('Miller', 'Okafor', 'Tanaka')[i % 3]}"),
        ("id", "his ssn {} is", f"{digit(1).replace('9', '1').replace('0', '2')}23-45-{digit(4)}"),
        ("phone", "call ({}) or", f"{2 + i % 8}15-555-{digit(4)}"),
        (None, "see https://example.org/{} for it", f"a-page/of-many-words/and-more-{i}"),
        (None, "the words {} follow", "ordinary-hyphenated-compound-words"),
    ]
    kind, text, body = cases[i % len(cases)]
    return kind, f"{EN} {text.format(body)} {EN}", (f"{kind}:{len(EN) + 1 + text.index('{')}:{len(EN) + 1 + text.index('{') + len(body)}")


def test_recall_of_planted_kinds(spark):
    """At least nine of ten planted cases of every kind, at most one of ten of those that only look like one."""
    rows = [planted(i) for i in range(450)]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.find_pii(spark, df).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    for kind in ("secret", "iban", "street", "name", "id", "phone"):
        mine = [i for i, r in enumerate(rows) if r[0] == kind]
        loose = lambda i: any(s.split(":")[0] == kind and abs(int(s.split(":")[1]) - int(rows[i][2].split(":")[1])) <= 1 for s in got[i] if s)  # noqa: B023, E731
        assert sum(map(loose, mine)) >= 0.9 * len(mine), kind
    clean = [i for i, r in enumerate(rows) if r[0] is None]
    assert sum(got[i] != [""] for i in clean) <= 0.1 * len(clean)


@pytest.mark.parametrize("n", [1e4, 1e7])
def test_labelers_with_known_rates(n):
    """Silent labelers too: what a vote is worth is found, and found alike, in small and large tables."""
    yes = [{1: 0.8, 0: 0.2}, {1: 0.3, -1: 0.7}, {1: 0.6, -1: 0.4}, {1: 0.85, 0: 0.15}, {0: 0.02, -1: 0.98}]
    no = [{1: 0.2, 0: 0.8}, {1: 0.01, -1: 0.99}, {1: 0.03, -1: 0.97}, {1: 0.25, 0: 0.75}, {0: 0.5, -1: 0.5}]
    rows = []
    for votes in itertools.product(*[sorted(y) for y in yes]):
        p, q = (math.prod(r[v] for r, v in zip(rates, votes)) for rates in (yes, no))
        count = round(n * (0.3 * p + 0.7 * q))
        if count:
            rows.append((votes, count))
    _, got, other = pii.estimated(rows)
    for j, v in enumerate([1, 1, 1, 1, 0]):
        assert got[j][v] / other[j][v] == pytest.approx(yes[j][v] / no[j][v], rel=0.2), j


def test_decisions_do_not_depend_on_the_size_of_the_table(spark):
    rows = [planted(i) for i in range(450)]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    facts = ["kind", *pii.LABELERS, *pii.FEATURES]
    found = written(spark, pii.candidates(df), "pii").select(F.explode("more").alias("c")).select(*[F.col(f"c.{f}") for f in facts])
    counts = [r.asDict() for r in found.groupBy(*facts).count().collect()]
    many = [r | {"count": 10_000 * r["count"]} for r in counts]
    decide = lambda w: [sum(a * b for a, b in zip(w, pii.features(r))) >= 0 for r in counts]
    assert decide(pii.learned(counts)) == decide(pii.learned(many)) and 0 < sum(decide(pii.learned(counts))) < len(counts)


def test_many_spans_in_one_text(spark):
    """A text of a megabyte with a base span or a candidate at every few characters, in seconds, and the same as brute force."""
    unit, n = "a@b.c x 415-555-1234 ", 50_000
    df = spark.createDataFrame([(0, unit * n), (1, unit * 3)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in pii.find_pii(spark, df).collect()}
    assert time.perf_counter() - start < 60
    assert len(got[0].base) == n and len(got[0].spans) in (n, 2 * n) and got[0].base[-1].start == len(unit) * (n - 1)
    assert [(s.kind, s.start) for s in got[0].spans[: len(got[1].spans)]] == [(s.kind, s.start) for s in got[1].spans]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=12), st.sampled_from([2, 256]))
def test_overlaps_against_brute_force(spark, some, base, block):
    old, pii.BLOCK = pii.BLOCK, block
    some = sorted({a: (a, a + n) for a, n in some}.values())
    base = sorted((a, a + n) for a, n in base)
    df = spark.createDataFrame([(some, base)], "s array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    got = pii.apart_from(df, "s", "b", "x").first().x
    pii.BLOCK = old
    assert sorted(tuple(x) for x in got) == [c for c in some if not any(b[0] < c[1] and c[0] < b[1] for b in base)]


def test_reliabilities_against_plain_em():
    """The same estimates as EM over single candidates, one by one instead of by counts."""
    rows = [((1, 1, -1), 13), ((0, 0, 0), 20), ((1, 0, -1), 4), ((0, 1, 0), 5), ((-1, -1, -1), 3)]
    single = [(v, 1) for v, n in rows for _ in range(n)]
    by_count, one_by_one = pii.estimated(rows)[0], pii.estimated(single)[0]
    assert one_by_one == pytest.approx([b for b, (_, n) in zip(by_count, rows) for _ in range(n)])


def test_fit_against_gradient_descent():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((40, 1)), rng.integers(0, 2, (40, 3))], 1)
    y, n = rng.uniform(0.1, 0.9, 40), rng.integers(1, 9, 40)
    w, got = np.zeros(4), pii.fit(list(zip(x.tolist(), y.tolist(), n.tolist())))
    n = n * (pii.SCALE / n.sum())
    for _ in range(20_000):
        w -= 0.001 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + 0.1 * w)
    assert got == pytest.approx(w.tolist(), abs=1e-3)


def test_pii_of_awkward_rows(spark):
    df = awkward(spark)
    out = pii.find_pii(spark, df)
    assert out.count() == df.count() and pii.find_pii(spark, empty(spark)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_reliabilities():
    rows = [((1, 1, -1), 40), ((0, 0, 0), 60), ((1, 0, -1), 5), ((0, 1, 0), 5)]
    belief = pii.estimated(rows)[0]
    assert belief[0] > 0.9 and belief[1] < 0.1


def test_windows_cover_whole_texts():
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, 5000):
        for stride in (WINDOW, WINDOW - 64):
            w, count = windows_of([b"a" * n, b"xyz"], stride)
            assert count[1] == 1 and len(w) == count.sum() and (count[0] - 1) * stride + WINDOW >= n
            assert (w[: count[0]] == 0).any(1).all() or n == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = ByteCnn(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 64, (4, WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones(4)

    def loss():
        z = np.maximum(net.responses(x, net.tables()).max(1) + net.p["b"], 0) @ net.p["d"] + net.p["o"]
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(4), y]).mean())

    grads = net.gradients(x, y, w)
    for name in ("e", "w2", "w3", "w4", "d", "b", "o"):
        spot = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, step = net.p[name][spot], 1e-4
        net.p[name][spot] = old + step
        up = loss()
        net.p[name][spot] = old - step
        down = loss()
        net.p[name][spot] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name][spot], rel=0.05)


def test_tables_against_a_plain_convolution():
    """Filters at every place of every window, one product at a time, against the tables of byte pairs."""
    rng = np.random.default_rng(3)
    net = ByteCnn(3, seed=2)
    net.p["b"] = rng.normal(0, 0.1, net.p["b"].shape).astype(np.float32)
    x, _ = windows_of([bytes(rng.integers(0, 256, 700, dtype=np.uint8)), b"short", EN.encode()])
    pooled = []
    for row in x:
        v, best = net.p["e"][row], []
        for w in WIDTHS:  # every place of a window at which the widest filter but one still lies inside it
            best.append(np.max([np.einsum("jd,jdf->f", v[i : i + w], net.p[f"w{w}"]) for i in range(WINDOW - max(w, 4) + 1)], 0))
        pooled.append(np.concatenate(best))
    want = np.maximum(np.array(pooled) + net.p["b"], 0) @ net.p["d"] + net.p["o"]
    assert np.allclose(net.logits(x), want, atol=1e-3)


def test_scores_against_single_windows(spark):
    """Documents scored in batches against each window scored by itself, on texts of one byte to some MB."""
    texts = ["x", EN, (EN + " ") * 20, "a very long text " * 120_000, "é" * 700, "12 34"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net, weights = ByteCnn(2, seed=5), np.array([0.1, 0.7, 0.2, -0.3])
    got = {r.doc_id: r.score for r in classifiers.score_quality(spark, df, (net, weights)).collect()}
    for i, t in enumerate(texts):
        raw, step = t.encode(), WINDOW - classifiers.OVERLAP
        chunks = [raw[a : a + WINDOW] for a in range(0, max(1, len(raw) - WINDOW + step), step)]
        z = np.array([np.diff(net.logits(windows_of([c])[0])[0])[0] for c in chunks], np.float64).clip(-20, 20)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-weights @ [1, z.mean(), z.max(), z.min()])), abs=1e-4)
    found = {r.doc_id: (r._lang_pred, r._score) for r in classifiers.identify_language(spark, df, (net, ["aa", "bb"])).collect()}
    for i, t in enumerate(texts[:3]):
        z = net.logits(windows_of([t.encode()])[0]).astype(np.float64)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = np.log(p).mean(0).argmax()
        assert found[i][0] == ["aa", "bb"][best] and found[i][1] == pytest.approx(p[:, best].mean(), abs=1e-5)
    assert found[5] == ("und", 0.0)


def test_letters():
    assert [classifiers.has_letter(t) for t in ("", None, "½ ² ① ٣ 12 _", "٣ا", "ª", "12a", "你")] == [False, False, False, True, True, True, True]


def test_samples_are_within_bounds(spark, monkeypatch):
    rows = [(i, "x" * (100 * i), "en") for i in range(1, 60)] + [(7, "repeated", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = df.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    drawn = classifiers.sample(df, labelled, "doc_id", "text", WINDOW)
    assert sorted(len(w) for _, w in drawn) == sorted(max(1, -(-(100 * i if i != 7 else 8) // WINDOW)) for i in range(1, 60))
    monkeypatch.setattr(classifiers, "TRAIN_BYTES", 40_000)
    fewer = classifiers.sample(df, labelled, "doc_id", "text", WINDOW)
    assert len(fewer) == 59 and sum(len(w) for _, w in fewer) * WINDOW < 40_000 + 59 * WINDOW
    monkeypatch.setattr(classifiers, "TRAIN_ROWS", 5)
    assert len(classifiers.sample(df, labelled, "doc_id", "text", WINDOW)) == 5
    assert classifiers.sample(df, labelled.limit(0), "doc_id", "text", WINDOW) == []


def test_samples_are_drawn_by_label(spark, monkeypatch):
    """A label of four rows among twenty thousand takes part; so does every one of more labels than fit evenly."""
    rows = [(i, f"t{i}", "zz" if i % 5000 == 7 else "aa") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = lambda n: Counter(x for x, _ in classifiers.sample(n, n.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), "doc_id", "text", WINDOW))
    got = count(df)
    assert got["zz"] == 4 and sum(got.values()) == classifiers.TRAIN_ROWS
    monkeypatch.setattr(classifiers, "TRAIN_ROWS", 40)
    got = count(df.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 10).cast("string"))))
    assert len(got) == 10 and sum(got.values()) == 40
    assert sum(count(df.withColumn("lang", (F.col("doc_id") % 400).cast("string"))).values()) == 40


def test_one_long_text_leaves_room_for_others(spark):
    """A text of 14 MB, the first in the order of the draw: its windows are spread over all of it, and all others are learned."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(EN.split(), 40)) if i % 2 else " ".join(rng.choice(DE.split(), 40)), i % 2) for i in range(300)]
    first = spark.createDataFrame([(i,) for i in range(300)], "id long").orderBy(F.xxhash64("id"), "id").first()[0]
    rows[first] = (first, (rows[first][1] + " ") * (14_000_000 // len(rows[first][1])), first % 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    drawn = classifiers.sample(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "doc_id", "text", WINDOW)
    assert len(drawn) == 300 and sum(w.size for _, w in drawn) < classifiers.TRAIN_BYTES + 300 * WINDOW
    model = classifiers.learn_quality(docs, labels, F.lit(True))
    got = classifiers.score_quality(spark, docs, model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_even_shares():
    assert [classifiers.even_shares(*x) for x in (([], 5), ([3, 4], 10), ([3, 4, 100], 13), ([9, 9, 9], 10), ([1, 20, 20], 21))] == [0, 4, 6, 3, 10]


def test_kept_columns_of_language(spark):
    df = awkward(spark)
    out = classifiers.identify_language(spark, df, None, keep=["_text", "score"])
    assert out.columns == ["doc_id", "_text", "score", "_lang_pred", "_score"] and out.count() == df.count()
    with pytest.raises(ValueError, match="_score"):
        classifiers.identify_language(spark, df.withColumn("_score", F.lit(1)), None, keep=["_score"])


def language_rows():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        lang, words = ("en", EN.split()) if i % 2 else ("de", DE.split())
        rows.append((i, " ".join(rng.choice(words, int(rng.integers(5, 200)))), lang, None, 0))
    return rows


def test_language(spark):
    train = spark.createDataFrame(language_rows(), SCHEMA)
    fold = classifiers.crc_of("doc_id") % 4
    model = classifiers.learn_language(train, fold != 2)
    got = classifiers.identify_language(spark, train, model, keep=["lang"]).withColumn("held_out", fold == 2)
    assert got.filter("held_out AND lang = _lang_pred").count() / got.filter("held_out").count() > 0.95
    odd = {r.doc_id: r for r in classifiers.identify_language(spark, awkward(spark), model).collect()}
    assert len(odd) == 14 and odd[3]._lang_pred == odd[4]._lang_pred == odd[6]._lang_pred == odd[9]._lang_pred == "und" and odd[11]._lang_pred == "en" and odd[7]._lang_pred == "de"
    assert {(r._lang_pred, r._score) for r in classifiers.identify_language(spark, awkward(spark), classifiers.learn_language(empty(spark), fold != 2)).collect()} == {("und", 0.0)}
    assert classifiers.identify_language(spark, empty(spark), model).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(240):
        words = rng.choice(EN.split(), int(rng.integers(5, 150)))
        good = i % 3 > 0
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    fold = classifiers.crc_of("doc_id") % 3
    model = classifiers.learn_quality(docs, marks, fold != 1)
    got = classifiers.score_quality(spark, docs, model).join(marks, "doc_id").filter(fold == 1).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    odd = classifiers.score_quality(spark, awkward(spark), model).toPandas()
    assert len(odd) == 15 and odd.score.between(0, 1).all()
    none = classifiers.learn_quality(docs, marks.limit(0), fold != 1)
    assert none is None and set(classifiers.score_quality(spark, docs, none).toPandas().score) == {0.5}


def test_pipeline_fills_missing_languages(spark):
    rows = [(i, (EN if i % 2 else DE) + f" {i}", None if i >= 300 else ("en" if i % 2 else "de"), "s", 1) for i in range(340)] + [(900, "123 !", None, "s", 1)]
    got = {r.doc_id: r.lang for r in language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(340)}

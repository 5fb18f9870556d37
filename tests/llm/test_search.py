import random
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import simhash
from corpusloom.llm.components import components
from corpusloom.llm.decontaminate import MASKS, Benchmark, contamination, words_of
from corpusloom.llm.topk import top_k
from tests.llm.helpers import CLASHING, EN, awkward, empty


def brute_print(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in range(max(1, len(tokens) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    """Smallest id reachable; ids that repeat are one node."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= radius:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


@pytest.mark.parametrize("radius, cell", [(4, 4096), (4, 3), (9, 4096), (0, 4096)])
def test_groups_against_brute_force(spark, radius, cell):
    rng = np.random.default_rng(radius)
    words = EN.split()
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "One two")]
    for i in range(60):
        base = rng.choice(words, 60).tolist()
        for j in range(4):
            rows.append((10 + 4 * i + j, " ".join(base)))
            base[int(rng.integers(60))] = "changed"
    hot = " ".join(rng.choice(words, 200))
    rows += [(1000 + i, hot + f" {i % 50}") for i in range(150)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, radius, cell=cell).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i].fp & (2**64 - 1) for i, _ in rows] == prints
    assert [got[i].component_id for i, _ in rows] == brute_components([i for i, _ in rows], prints, radius)


def test_groups_of_awkward_rows(spark):
    df = awkward(spark)
    got = simhash.near_duplicates(spark, df, 4, 4)
    assert got.count() == df.count()
    rows = {(r.doc_id, r.component_id) for r in got.collect()}
    assert (3, 3) in rows and (4, 3) in rows and (6, 3) in rows and (2, 1) in rows and (12, 10) in rows and (None, None) in rows
    assert simhash.near_duplicates(spark, empty(spark), 4, 4).count() == 0


def test_null_ids_join_no_unrelated_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    df = spark.createDataFrame([(5, a), (9, b), (None, a), (None, b), (None, "on its own here")], "doc_id long, text string")
    for options in ({}, {"least": 0.8}):
        got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, df, 4, 4, **options).collect()}
        assert got == {(5, 5), (9, 9)} | ({(None, None)} if options else {(None, 5), (None, 9), (None, None)})


def test_equal_fingerprints_of_different_texts_are_verified(spark):
    banner = "buy two get one free right now " * 50
    rows = [(i, banner + " ".join(f"d{i}w{j}" for j in range(200))) for i in range(4)] + [(4, "two three"), (5, "TWO  three")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 10, least=0.8).collect()}
    assert len({got[i].fp for i in range(4)}) == 1
    assert {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def jaccard(a, b, words=5):
    a, b = ({tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def pairs_near(rng, count, words, changed):
    """Pairs of texts of ``words`` words, the second with ``changed`` of them replaced, at least five words apart."""
    rows = []
    for i in range(count):
        text = [f"p{i}w{j}" for j in range(words)]
        rows.append((2 * i, " ".join(text)))
        for j in rng.choice(words // 5, changed, replace=False):
            text[5 * j + 2] = f"p{i}new{j}"
        rows.append((2 * i + 1, " ".join(text)))
    return rows


def test_long_texts_are_compared_exactly(spark):
    rng = np.random.default_rng(3)
    rows = pairs_near(rng, 24, 1500, 34) + [(100 + i, t.replace("p", "q")) for i, t in pairs_near(rng, 24, 1500, 32)]
    want = {a: jaccard(s, t) >= 0.8 for (a, s), (_, t) in zip(rows[::2], rows[1::2])}
    assert len(set(want.values())) == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, df, 5, 24, least=0.8).collect()}
    assert {a: got[a + 1] == a for a in want} == want


def test_pairs_far_apart_in_bits_are_found(spark):
    rows = pairs_near(np.random.default_rng(4), 60, 300, 6)
    assert all(0.8 <= jaccard(a, b) < 0.83 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(spark, df, 5, 10, least=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert any((fp[i] ^ fp[i + 1]).bit_count() > 10 for i in range(0, 120, 2))


@pytest.mark.parametrize("block", [2048, 24])
def test_large_groups_of_verified_links(spark, block):
    """A chain of texts, each near the next ones only, one text's many copies with different changes, and two families of
    fingerprints all near each other whose texts are unlike."""
    words, rng = [f"c{i}" for i in range(3000)], np.random.default_rng(6)
    rows = [(i, " ".join(words[10 * i : 10 * i + 200])) for i in range(200)]
    for i in range(150):
        some = [f"g{j}" for j in range(200)]
        for j in rng.choice(200, int(rng.integers(1, 7)), replace=False):
            some[j] = f"g{i}new{j}"
        rows.append((1000 + i, " ".join(some)))
    banner = "a long banner of seven words here " * 90
    for i in range(120):  # the banner decides nearly all bits, the rest is like in one family only
        some = [f"{'left' if i % 2 else 'right'}{j}" for j in range(300)]
        for j in rng.choice(300, 2, replace=False):
            some[j] = f"h{i}new{j}"
        rows.append((2000 + i, banner + " ".join(some)))
    root = {i: i for i, _ in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    for i, _ in rows:
        for j in root:
            if j < i and root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 10, least=0.8, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert {root[2000], root[2001]} == {2000, 2001} and sum(r == 2000 for r in root.values()) > 50


def test_verified_groups(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = words[:100] + ["new"] + words[101:], [w if i % 4 else f"x{i}" for i, w in enumerate(words)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, df, 5, 40, least=0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    a, b = (simhash.shingle_set(simhash.shingles(" ".join(w).encode(), 5)) for w in (words, near))
    assert simhash.similarity(a, b) == pytest.approx(191 / 201)


def test_signatures_follow_similarity():
    """Estimates of pairs at 0.8 stay clear of the limits that decide without the sets."""
    reject, accept = simhash.limits(0.8)
    for s, low, high in ((0.8, reject, accept), (0.3, 0, reject), (1.0, accept, 129)):
        for seed in range(60):
            rng = np.random.default_rng(seed)
            both = rng.integers(0, 2**63, int(1800 * s), np.uint64)
            one, two = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (1800 - len(both)) // 2, np.uint64)])) for _ in range(2))
            a, b = (np.frombuffer(simhash.signature(simhash.minwise(x)), np.uint8) for x in (one, two))
            assert low <= (a == b).sum() < high, (s, simhash.similarity(one, two))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 14), st.lists(st.integers(0, 30), min_size=1, max_size=10))
def test_allocation_is_a_pigeonhole(radius, sizes):
    costs = [[0.0] + [float(s * 3**t) for t in range(6)] for s in sizes]
    try:
        _, ts = simhash.allocate(costs, radius)
    except KeyError:
        assert 6 * len(sizes) < radius + 1
        return
    assert sum(t + 1 for t in ts) == radius + 1 and min(ts) >= -1


def test_bits_are_grouped_evenly():
    c = np.zeros((64, 64))
    c[3, 60] = c[60, 3] = c[5, 6] = c[6, 5] = 0.9
    for parts in range(1, 16):
        bins = simhash.grouped_bits(c, parts)
        assert sorted(sum(bins, [])) == list(range(64)) and max(map(len, bins)) - min(map(len, bins)) <= 1
    assert any({3, 60} <= set(b) for b in simhash.grouped_bits(c, 5))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({i for a, b in pairs if a != b for i in (a, b)})
    root = {i: i for i in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def brute_topk(rows, k, every):
    fine = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = max({len(v) for _, v in fine}, key=lambda n: (sum(len(v) == n for _, v in fine), n))
    fine = [(i, v) for i, v in fine if len(v) == size]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        mine = min((v.tolist() for i, v in fine if i == q))
        best = sorted(((-int(np.dot(mine, v)), i) for i, v in fine if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_topk(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(120)] + [(i, [0.5] * 8) for i in range(120, 140)]
    rows += [(None, [1.0] * 8), (200, None), (201, [None] + [1.0] * 7), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [1.0]), (20, [9.0] * 8), (7, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS v")
    got = top_k(spark, df, every=20, k=10, block=block)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(single, 10, 20)


def test_topk_of_few_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    assert top_k(spark, spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, -1.0]), (1, [-1.0, 1.0]), (100, [1e6, 1e6])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in top_k(spark, few).orderBy("query_id", "rank").collect()] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_topk_of_very_large_components(spark):
    """Products beyond 2^53 stay exact in whole numbers; beyond a long they are an error, not a wrong result."""
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [float(2**18 + i), float(2**19 - i), -1.0]) for i in range(40)] + [(100, [2.0**18, 2.0**19, 3.0])]
    got = top_k(spark, spark.createDataFrame(rows, schema), every=20, block=2)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows, 10, 20)
    with pytest.raises(Exception, match="do not fit a long"):
        top_k(spark, spark.createDataFrame([(0, [1e16]), (1, [1e16])], schema)).collect()


def items_of(spark, docs, bench, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {r.doc_id: r["items"] for r in contamination(spark, d, b, **options).collect()}


def test_contamination(spark):
    item = "Alpha beta gamma delta, epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
    words = item.split()
    two = words[:6] + ["X"] + words[7:11] + ["Y"] + words[12:]
    half = [w if i % 2 else "X" for i, w in enumerate(words)]
    docs = [f"before {item.upper()} after", f"before {' '.join(two)} after", " ".join(half), "alpha beta gamma delta epsilon only", None, "", "tiny item", f"{EN} " * 50 + "short words here", " ".join(words[3:17])]
    got = items_of(spark, docs, [item, None, "", "short words here", "!!!"])
    assert got == {0: [0], 1: [0], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [3], 8: [0]}
    assert items_of(spark, docs, [item, None, "", "short words here", "!!!"], limit=1) == got
    assert items_of(spark, docs, []) == {i: [] for i in range(len(docs))}


def brute_contains(text, item, span=13, similarity=0.8):
    """Whether some stretch of ``span`` words (all of a shorter item) agrees in enough places, tried at every diagonal."""
    a, b = words_of(text), words_of(item)
    need = min(span, len(b))
    for i in range(len(a) - need + 1):
        for j in range(len(b) - need + 1) if need else ():
            if sum(x == y for x, y in zip(a[i : i + need], b[j : j + need])) >= similarity * need - 1e-9:
                return True
    return False


def test_contamination_against_brute_force(spark, monkeypatch):
    """Items of 5 to 30 words, pasted whole or in part, with words changed, into texts; blocks written on the way as well."""
    from corpusloom.llm import decontaminate

    rng = np.random.default_rng(8)
    draw = lambda n: [f"v{int(x)}" for x in rng.integers(0, 400, n)]
    bench = [" ".join(draw(int(rng.integers(5, 31)))) for _ in range(12)]
    docs = []
    for i in range(140):
        body, words = draw(40), bench[i % 12].split()
        part = words[: int(rng.integers(5, len(words) + 1))] if i % 3 == 0 else words
        for at in rng.choice(len(part), min(len(part), i % 5), replace=False):
            part = [*part[:at], "changed", *part[at + 1 :]]
        docs.append(" ".join(body[:20] + part + body[20:]).title())
    want = {i: [j for j, b in enumerate(bench) if brute_contains(d, b)] for i, d in enumerate(docs)}
    assert 20 < sum(map(bool, want.values())) < 130
    got = items_of(spark, docs, bench)
    missed = [(i, j) for i in want for j in want[i] if j not in got[i]]
    # what brute force finds by chance, two thirds or so of a long stretch at many places, has at most two changed words
    assert not missed and all(j in want[i] for i in got for j in got[i])
    monkeypatch.setattr(decontaminate, "PASSES", 2)
    assert items_of(spark, docs, bench, limit=1) == got


def numbered(bench, text):
    ids = bench.numbers(words_of(text))
    return np.append(ids, 0), np.array([len(ids) + 1])


def test_repeated_words_stay_cheap():
    """Every seed of the text hits every place of the item: work follows the diagonals, and memory a block of them."""
    bench = Benchmark([(1, [b"a"] * 2000), (2, [b"a"] * 5 + [b"b%d" % i for i in range(30)]), (3, [b"c", b"d"] * 700)])
    tracemalloc.start()
    begin = time.perf_counter()
    found = bench.matches(*numbered(bench, "a " * 300_000 + "c d " * 30_000), 13, 0.8)
    took, peak = time.perf_counter() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0), (0, 2)} and took < 60 and peak < 300e6


def test_repetitive_texts_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        items = [(i, [rng.choice([b"a", b"b", b"c"][: rng.choice([1, 2, 3])]) for _ in range(rng.choice([3, 6, 13, 20, 40]))]) for i in range(4)]
        bench = Benchmark(items)
        texts = [" ".join(rng.choice("abx"[: rng.choice([1, 2, 3])]) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        rows = [bench.numbers(words_of(t)) for t in texts]
        flat, ends = np.concatenate([np.append(r, 0) for r in rows]), np.cumsum([len(r) + 1 for r in rows])
        want = {(d, k) for d, t in enumerate(texts) for k, (_, w) in enumerate(items) if brute_contains(t, b" ".join(w).decode())}
        assert bench.matches(flat, ends, 13, 0.8) == want


def test_kept_columns_of_contamination(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(5, EN)], "item_id long, text string")
    assert contamination(spark, df, bench, keep=["_text", "score"]).columns == ["doc_id", "_text", "score", "items"]
    with pytest.raises(ValueError, match="items"):
        contamination(spark, df, bench, keep=["items"])


@pytest.mark.parametrize("n", range(4, 13))
def test_short_items_with_a_fifth_of_their_words_changed(n):
    from itertools import combinations

    words = [b"w%d" % i for i in range(n)]
    bench = Benchmark([(7, words)])
    for k in range(n // 5 + 2):
        for bad in combinations(range(n), k):
            numbers = bench.numbers([b"before", *[b"x" if i in bad else w for i, w in enumerate(words)], b"after"])
            flat = np.append(numbers, 0)
            assert bench.matches(flat, np.array([len(flat)]), 13, 0.8) == ({(0, 0)} if n - k >= 0.8 * n - 1e-9 else set())


def test_contamination_of_awkward_rows(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(5, EN), (5, EN), (None, EN)], "item_id long, text string").selectExpr("*", *[f"1 AS `{c}`" for c in CLASHING])
    got = contamination(spark, df, bench)
    assert got.count() == df.count() and {r.doc_id for r in got.collect() if r["items"] == [5]} == {1, 2, 5, 11}
    assert contamination(spark, empty(spark), bench).count() == 0


def test_masks_find_two_substitutions_in_any_13_words():
    from itertools import combinations

    for bad in combinations(range(13), 2):
        assert any(all(a + p not in bad for p, c in enumerate(m) if c == "1") for m in MASKS for a in range(13 - len(m) + 1))

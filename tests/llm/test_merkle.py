import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle
from corpusloom.llm.merkle import Forest, checked, fold, leaf_digest, merkle_manifest, parent, steps_of
from tests.llm.helpers import awkward, empty

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(leaves, arity=3):
    """All levels of a tree, lowest first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity=3):
    out = []
    for level in tree[:-1]:
        run = i // arity * arity
        out += [level[j] for j in range(run, min(run + arity, len(level))) if j != i]
        i //= arity
    return out


def brute(rows, arity=3):
    """{(doc_id, leaf): set of (subroot, root, proof)} of rows as tuples of FIELDS."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*map(part, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([h for _, h in sorted(groups[g])], arity) for g in order}
    top = levels([trees[g][-1][0] for g in order], arity)
    out = {}
    for k, g in enumerate(order):
        for i, ((known, ident), h) in enumerate(sorted(groups[g])):
            proof = digest(*path(trees[g], i, arity), *path(top, k, arity))
            out.setdefault((ident if known else None, h), set()).add((trees[g][-1][0], top[-1][0], proof))
    return out


def same(spark, df, arity=3):
    got = checked(merkle_manifest(spark, df, fields=FIELDS, arity=arity), "leaf", ["doc_id", "leaf", "subroot", "root"]).collect()
    want = brute([tuple(r) for r in df.select(FIELDS).collect()], arity)
    found = {}
    for r in got:
        assert r.folded_root == r.root
        found.setdefault((r.doc_id, r.leaf), set()).add((r.subroot, r.root, r.proof_sha256))
    assert len(got) == df.count() and found == want


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_forests_merge_in_any_order(arity):
    rng = random.Random(arity)
    widths = [1, 2, arity, 40, 7, 1, arity**3]
    leaves = [(t, i, bytes([t]) * 31 + bytes([i % 256]), w) for t, w in enumerate(widths) for i in range(w)]
    want = None
    for _ in range(20):
        rng.shuffle(leaves)
        parts = [Forest(arity, len(widths)) for _ in range(rng.randint(1, 9))]
        for n, (t, i, d, w) in enumerate(leaves):
            parts[n % len(parts)].add(t, 0, i, d, w)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].merge(parts[i + 1])]
        got = sorted(parts[0].done)
        assert not parts[0].open_nodes() and got == (want or got)
        want = got


def test_awkward_rows(spark):
    df = awkward(spark)
    same(spark, df)
    sources = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("é"), (F.col("doc_id") % 4).cast("string"))))
    same(spark, sources)
    got = merkle_manifest(spark, df, fields=FIELDS, keep=["shard", "ids"])
    assert got.columns == ["doc_id", "shard", "ids", "leaf", "subroot", "root", "path"] and got.count() == df.count()
    none = merkle_manifest(spark, empty(spark), fields=FIELDS)
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "path"]
    same(spark, df.filter("doc_id = 7"))
    with pytest.raises(ValueError):
        merkle_manifest(spark, df.withColumn("path", F.lit(1)), fields=FIELDS, keep=["path"])


@pytest.mark.parametrize("span", [1, 6])
def test_blocks_of_levels_and_many_parts(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "PIECE_ROWS", 60)
    rows = [(i, "hot" if i % 3 else f"s{i % 59}", None, i, f"t{i}\nx") for i in range(700)] + [(5, "hot", None, 5, "again")] * 4
    same(spark, spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), 3 if span > 1 else 4)


def test_tampering_shows(spark):
    df = awkward(spark, repeated=False).withColumn("held", leaf_digest(*[F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]))
    got = {r.doc_id: r for r in checked(merkle_manifest(spark, df, fields=FIELDS, keep=["held"]), "held", ["doc_id", "leaf", "root"]).collect()}
    for r in df.collect():
        assert (got[r.doc_id].folded_root == got[r.doc_id].root) == ("\n" not in (r.text or ""))


def test_fold_and_steps():
    a, b, c = (bytes([x]) * 32 for x in (1, 2, 3))
    p = merkle.step(1, a + b + c) + merkle.step(0, a)
    assert list(steps_of(p)) == [(1, [a, c]), (0, [])] and fold(b, p) == parent([parent([a, b, c])])

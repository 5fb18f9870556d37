import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import rans
from corpusloom.llm.encoding import WordEncoder, default_path, slices, worker_encoder
from corpusloom.llm.packing import Layout, Sums, pack_documents, plan_patterns
from corpusloom.llm.token_files import token_files
from tests.llm.helpers import awkward, empty

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ODD = ["", " ", "a  b", " x", "x ", "a \n b", "a\n b", "\xa0 b c", "tab\t x  y", " 1 2", "<|endoftext|> hello", "don't  stop 's it's.", "é x", "foo.\nBar, baz;\nQ", "x\n\ny z", "a \0 b", "a\0b", "İstanbul İ. ΣΣ", "\x1c A\x1cb \x1c\x85", "!!! ###. a!!! b***", "é", "日本語 テキスト。"]


@pytest.fixture(scope="module", params=FILES)
def encoder(request):
    return WordEncoder(default_path(request.param), FILES[request.param], limit=40), Tokenizer.from_file(default_path(request.param))


def plain(tokenizer, text):
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_texts(encoder):
    assert encoder[0](pa.array(ODD)) == [plain(encoder[1], t) for t in ODD]
    assert encoder[0](pa.array([], pa.string())) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZé \n\t.,!'’1٢́\x1c\x85\xa0ßİΣ"), max_size=40), max_size=4))
def test_any_text(encoder, some):
    assert encoder[0](pa.array(some, pa.string())) == [plain(encoder[1], t) for t in some]


def test_all_letters(encoder):
    """Every letter of Unicode alone, within a word, and before marks, whatever was learned before."""
    letters = [c for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff" and c.isalpha()]
    fresh = WordEncoder(default_path("byte_bpe_50k.json" if encoder[0].spaced else "word_bpe_49k.json"), encoder[0].spaced)
    forms = ["{}", "{}.", "a{}b", "ab{}!? x", "{}.\n{}"]
    for form in [*forms, *forms[::-1]]:
        some = [form.replace("{}", c) for c in letters[:: 1 if form == "{}." else 7]]
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder[1].encode_batch_fast(some, add_special_tokens=False)]
        assert fresh(pa.array(some)) == want, form


ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from("abZé .,!'İΣक़क\u093cßﬀ\u0301가각"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=ALPHABET, max_size=4), max_size=6).map(" ".join), min_size=1, max_size=4), st.randoms())
def test_any_order(encoder, some, random):
    """Ids do not depend on the pieces that a worker has met before, or on their order."""
    pieces = [w + m for t in some for w in t.split(" ") for m in ("", ".", "!?")]
    random.shuffle(pieces)
    fresh = WordEncoder(default_path("byte_bpe_50k.json" if encoder[0].spaced else "word_bpe_49k.json"), encoder[0].spaced) if len(pieces) < 9 else encoder[0]
    for w in pieces:
        assert fresh(pa.array([w])) == [plain(encoder[1], w)]
    assert fresh(pa.array(some)) == [plain(encoder[1], t) for t in some]


@pytest.mark.parametrize("name", FILES)
def test_strings_of_added_tokens_are_those_tokens(name):
    texts = ["one <|endoftext|> two", "plain", "a<|startoftext|>b  <|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext|>", "", "<| endoftext |>"]
    tokenizer = Tokenizer.from_file(default_path(name))
    got = worker_encoder(default_path(name), FILES[name])(pa.array(texts))
    assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(got[4]) == 4


def test_slices():
    batch = pa.record_batch({"t": ["a" * n for n in (3, 9, 1, 1, 20)]})
    assert [s.num_rows for s in slices(batch, 0, 10)] == [1, 1, 2, 1] or sum(s.num_rows for s in slices(batch, 0, 10)) == 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=400), st.integers(0, 3))
def test_rans_round_trip(some, times):
    ids = np.array(some * (1 + 9 * times), np.uint32)
    docs, lengths, back, before, null = rans.read_segment(rans.encode_segment(np.array([5, -(2**63)]), np.array([len(ids), 0]), ids, 7, np.array([True, False])))
    assert (back == ids).all() and len(back) == len(ids) and docs.tolist() == [5, -(2**63)] and lengths.tolist() == [len(ids), 0]
    assert before == 7 and null.tolist() == [True, False]


def test_rans_blocks_checkpoints_and_checksums(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 20_000)
    ids = (np.random.default_rng(0).zipf(1.3, 50_000) % 5000).astype(np.uint32)
    raw = rans.encode_segment(np.array([1]), np.array([len(ids)]), ids, 0)
    assert (rans.read_segment(raw)[2] == ids).all()
    assert len(raw) < 2.2 * len(ids) + 3 * 2 * 8 * rans.LANES
    table = rans.Table.of(ids[:20_000])
    block = rans.encode_block(ids[:20_000], table.dense())
    assert (rans.decode_block(memoryview(block), table.slots(), from_checkpoint=True) == ids[:20_000][-(-20_000 // rans.LANES) // 2 * rans.LANES :]).all()
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_block(memoryview(bytes(broken)), table.slots())


def test_token_files(spark):
    df, path = awkward(spark), default_path("word_bpe_49k.json")
    got = token_files(spark, df, path, files=3).toPandas().sort_values("start").reset_index(drop=True)
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, plain(tokenizer, r.text or "") + b"\2\0\0\0") for r in df.collect()))
    assert [bytes(x) for x in got.ids] == [r[2] for r in rows]
    assert got.start.tolist() == np.cumsum([0, *(len(r[2]) // 4 for r in rows)])[:-1].tolist()
    assert token_files(spark, empty(spark), path).count() == 0


def test_extreme_ids_and_a_long_text(spark):
    """Ids at both ends of the range beside nulls, and a text of some MB, in files and in packing."""
    path = default_path("word_bpe_49k.json")
    long = "some words that repeat again and again, " * 60_000
    df = spark.createDataFrame([(None, "a"), (2**63 - 1, "b"), (-(2**63), "c d"), (2**53 + 1, long), (None, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files(spark, df.filter("doc_id is not null or text is null"), path).collect()}
    n = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids) + 1
    assert got == {None: (0, 1), -(2**63): (1, 3), 2**53 + 1: (4, n), 2**63 - 1: (4 + n, 2)}
    packed = pack_documents(spark, df, default_path("byte_bpe_50k.json")).assign().toPandas()
    assert len(packed) > 400 and (packed.length <= 1024).all() and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert {r.doc_id for r in pack_documents(spark, df, default_path("byte_bpe_50k.json")).assign().collect()} == {None, 2**63 - 1, -(2**63), 2**53 + 1}


def best_known(counts, capacity):
    return -(-int((counts * np.arange(len(counts))).sum()) // capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_patterns_hold_every_piece(lengths):
    counts = np.bincount(lengths, minlength=33)
    patterns = plan_patterns(counts, 32)
    used = np.zeros(33, int)
    for some, times in patterns:
        assert sum(some) <= 32 and times > 0
        for n in some:
            used[n] += times
    assert (used == counts).all()
    layout, taken = Layout(patterns, 32), {}
    for n in set(lengths):
        s, o = layout.places(np.full(counts[n], n), np.arange(counts[n]))
        for a, b in zip(s.tolist(), o.tolist()):
            taken.setdefault(a, []).append((b, n))
    for row in taken.values():
        row.sort()
        assert all(b == sum(n for _, n in row[:i]) for i, (b, _) in enumerate(row))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4)), max_size=30))
def test_index_of_sums(changes):
    """The index after any changes of counts against all combinations counted anew, and what it finds."""
    from itertools import combinations_with_replacement

    sums = Sums(np.zeros(21, int), 20)
    for n, count in changes:
        sums.put(n, count)
    fine = lambda c: all(sums.have[x] >= c.count(x) for x in c)
    for k, counted in ((2, sums.pairs + sums.doubles), (3, sums.triples + sums.mixed + sums.cubes)):
        combos = [c for c in combinations_with_replacement(range(1, 21), k) if fine(c) and sum(c) <= 20]
        assert [sum(sum(c) == s for c in combos) for s in range(21)] == counted.tolist()
        for s in range(2, 21):
            want = max((tuple(sorted(c, reverse=True)) for c in combos if sum(c) == s), default=None)
            assert (sums.pair(s) if k == 2 else sums.triple(s)) == want


def test_exact_complements():
    counts = np.bincount([20, 12, 20, 7, 5, 10, 9, 9, 4], minlength=33)
    assert sorted(tuple(sorted(p)) for p, t in plan_patterns(counts, 32) for _ in range(t)) == [(4, 9, 9, 10), (5, 7, 20), (12, 20)]
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 1024, 20_000), minlength=1025)
    assert sum(t for _, t in plan_patterns(counts, 1024)) <= best_known(counts, 1024) * 1.005 + 1


def test_packing(spark):
    df, path = awkward(spark), default_path("byte_bpe_50k.json")
    packed = pack_documents(spark, df, path, capacity=64)
    got = packed.assign().toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in df.collect():
        ids = plain(tokenizer, r.text or "") + b"\2\0\0\0"
        n = len(ids) // 4
        head = (n - 1) % 64 + 1
        cuts = [0, *range(head, n + 1, 64)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple((v is not None and v == v, 0 if v is None or v != v else v) for v in x)
    assert sorted(map(key, zip(got.doc_id, got.piece, got.start, got.length, map(zlib.crc32, got.ids)))) == sorted(map(key, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    whole = {r.sequence_id: bytes(r.ids) for r in packed.sequences().collect()}
    first = got[got.offset == 0].iloc[0]
    assert whole[first.sequence_id].startswith(first.ids) and sum(map(len, whole.values())) == 4 * got.length.sum()
    assert pack_documents(spark, empty(spark), path).assign().count() == 0

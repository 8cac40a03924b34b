"""Packing, cross-tokenizer alignment and whitening on awkward tables, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelforge.llm import alignment, packing, queries, stretches, whitening

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a long, part int, sequence_id string, `_row` string, vec string"
LONG = " ".join(f"w{k % 977}x{k % 53}" for k in range(9_000))
TEXTS = [
    None, "", " ", "  \n ", "a", "one two", "one  two ", "\tx y\n", "naïve été ünder", "日本語 テキスト", "😀 😀😀", "a<|endoftext|>b <s> </s> <unk> <0x41>", "▁ x▁ y", "x  y", "x  y",
    "it's we'll 123 4567.89 don't", LONG, LONG, LONG + " tail", "zero\u0000byte", "é ́x", "﻿bom", "…" * 50, " lead", "trail ", "x" * 3000,
]


def table(spark, texts):
    rows = [(k, t, 1, 2, "c", "c", "c") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[5], rows[5], (None, "no id", 1, 2, "c", "c", "c")], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def test_stretches_give_the_ids_of_whole_texts(tokenizer):
    texts = [t or "" for t in TEXTS]
    encoder = stretches.StretchEncoder(stretches.bpe_encode(open(A).read()), spaced=True, kept=50)
    for _ in range(2):
        flat, lens = encoder.ids(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert stretches.batches(np.array([5, 5, 99, 1, 1]), 10) == [(0, 2), (2, 3), (3, 5)]
    assert encoder.ids(pa.array([], pa.string()))[0].size == 0


# 13 ----------------------------------------------------------------------------------------------
def check_packed(rows, want, length):
    """Every id of every document in one piece; sequences gapless, full or a power of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for d, found in pieces.items():
        copies = want[d]
        got = Counter((r.start, r.length, r.ids_crc32) for r in found)
        assert sum(r.length for r in found) == sum(map(len, copies)) and all(r.doc_tokens == len(copies[0]) for r in found)
        assert all(zlib.crc32(copies[0][s : s + n].tobytes()) == c for s, n, c in got)
        assert Counter(k for s, n, _ in got.elements() for k in range(s, s + n)) == Counter({k: len(copies) for k in range(len(copies[0]))})
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize("length, windows, fan_in", [(2048, 16, 32), (64, 3, 2)])
def test_packing(spark, docs, tokenizer, monkeypatch, length, windows, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4"))
    rows = packing.pack_documents(docs.repartition(5), A, length=length, windows=windows).collect()
    sequences = check_packed(rows, want, length)
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(sum(r.length for r in s) < length for s in sequences.values()) == bin(total % length).count("1")


def test_packing_keeps_short_documents_whole_where_they_fit():
    packer = packing.Packer(0, 8, 2)
    for k, n in enumerate((5, 6, 2, 3)):
        packer.add(k, 0, np.arange(n, dtype=np.uint32), n)
    rows = packer.taken().to_pylist()
    # 2 fits the fuller window (6) best; 3 fits the other.
    assert [(r["doc_id"], r["sequence_id"], r["offset"]) for r in rows] == [(1, 0, 0), (2, 0, 6), (0, 1, 0), (3, 1, 5)] and not packer.open


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty, A).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty, A, length=1000)


# 11 ----------------------------------------------------------------------------------------------
def plain_alignment(texts):
    """(doc_id, text) to counts, links and groups by one pass over both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s, decoded = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_table()
    t.encode_special_tokens = True
    of_a = {i: bytes(decoded[c] for c in w) for w, i in t.get_vocab().items() if all(c in decoded for c in w)}
    of_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for d, text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(of_a[i] for i in a) != whole or b"".join(map(of_b, b)) != whole:
            found.append((d, 0, 0, [], [], 0))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in ([of_a[i] for i in a], [of_b(i) for i in b]))
        both, groups, links, k, j = sorted({*ends_a} & {*ends_b}), [], [], 0, 0
        for e in both:
            i, m = ends_a.index(e, k) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, a[k:i])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[i - 1], b[m - 1]))
            k, j = i, m
        overlaps, j = 0, 0
        for x, (lo, hi) in enumerate(zip([0, *ends_a], ends_a)):
            overlaps += sum(1 for lo_b, hi_b in zip([0, *ends_b], ends_b) if lo < hi_b and lo_b < hi) if len(a) < 500 else 0
        found.append((d, len(a), len(b), groups, links, overlaps))
    counts = Counter(x for f in found for x in f[4])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(d, na, nb, len(g), len(ln), ";".join(g), sum(counts[x] == top[x[1]] for x in ln), sum(counts[x] for x in ln), o) for d, na, nb, g, ln, o in found]


@pytest.mark.parametrize("sent_pairs", [alignment.SENT_PAIRS, 0])
def test_alignment(spark, docs, sent_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 40)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 3000)
    made = alignment.aligned(docs, A, B, digest=False)
    got = alignment.scored(made, 32_000, sent_pairs).collect()
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum, r.n_overlaps if r.n_a < 500 else 0) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sum(r.n_a == 0 for r in got) >= 3
    digests = {r.doc_id: r.groups for r in alignment.align(docs, A, B).collect()}
    assert all(digests[d] == (hashlib.sha256(g.encode()).hexdigest() if g else "") for d, *_, g, _, _, _ in want)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty, A, B).count() == 0
    assert [(r.n_a, r.groups) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()] == [(0, ""), (0, "")]


def test_alignment_holds_few_rows_and_links_at_once(spark, docs, monkeypatch):
    """Arrow batches of the session's length held all links of 10,000 documents, which a task looked up at once."""
    key, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, alignment.common.saved

    def saved(df, name):
        seen[name] = int(spark.conf.get(key))
        return keep(df, name)

    monkeypatch.setattr(alignment.common, "saved", saved)
    before, want = spark.conf.get(key), sorted(alignment.align(docs, A, B).collect(), key=str)
    assert seen["aligned"] <= alignment.ARROW_ROWS and seen["scored"] <= alignment.ARROW_ROWS and spark.conf.get(key) == before
    monkeypatch.setattr(alignment, "ARROW_ROWS", 3)
    monkeypatch.setattr(alignment, "SCORED_LINKS", 5)
    assert sorted(alignment.align(docs, A, B).collect(), key=str) == want and seen["scored"] == 3
    places = alignment.intervals(np.array([1, 0], np.uint32), np.array([2]), np.array([1, 2], np.int64), np.array([0], np.int32))
    assert {str(t) for t in places.schema.types} == {"int32"} and places["stop"].to_pylist() == [2, 3]


# 12 ----------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, n long, component string, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 1, "c", "c") for k, v in rows], VECTORS)


def dense(vectors, wanted=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return c @ u[:, ::-1][:, :wanted] / np.sqrt(e[::-1][:wanted]), e[::-1] / e.sum(), ((n * x - sums).astype(np.int64) ** 2).sum(1)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)) * 0.1).tolist()
    bad = [None, [], [None] * 20, [1.0] * 19 + [None], [float("nan")] * 20, [float("inf")] + [0.0] * 19, [1.0] * 7, [3e38] * 20]
    rows = [(k, v) for k, v in enumerate(good)] + [(None, good[0]), (5, good[5])] + [(1000 + k, v) for k, v in enumerate(bad)]
    got = whitening.whiten(vectors_of(spark, rows).repartition(4)).collect()
    used = good + [good[0], good[5]]
    want, shares, deviations = dense(used)
    assert len(got) == 8 * len(used) and {r.n for r in got} == {len(used)} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    for c in range(8):
        mine = {r.vec_id: r for r in got if r.component == c + 1 and r.vec_id not in (None, 5)}
        values = np.array([mine[k].whitened for k in range(300) if k != 5])
        ref = np.delete(want[:300, c], 5)
        assert min(np.abs(values - ref).max(), np.abs(values + ref).max()) < 1e-9
        assert abs(mine[0].explained / shares[c] - 1) < 1e-9
    assert all(r.deviation == deviations[r.vec_id] for r in got if r.vec_id is not None)


def test_whitening_of_few_dimensions_and_rows(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(vectors_of(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)])).collect()
    assert {r.component for r in flat} == {1} and sorted(r.vec_id for r in flat) == list(range(5)) and abs(flat[0].explained - 1) < 1e-9


@pytest.mark.parametrize("d, rank", [(5, 5), (60, 60), (300, 300), (300, 9), (40, 3)])
def test_lanczos_equals_a_dense_solution(d, rank):
    rng = np.random.default_rng(d + rank)
    u, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.zeros(d)
    e[:rank] = np.sort(rng.random(rank))[::-1] + 0.5
    e[: min(3, rank)] += [9, 9, 4][: min(3, rank)]
    m = (u * e) @ u.T
    passes = []
    values, vectors = whitening.top_components(lambda v: passes.append(v.shape[1]) or m @ v, d)
    k = min(8, d)
    want = np.sort(e)[::-1][:k]
    assert np.abs(values - want).max() < 1e-12 * e.max()
    assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * e.max() and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_lanczos_starts_again_from_the_best(monkeypatch):
    monkeypatch.setattr(whitening, "BASIS_BLOCKS", 3)
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    e = 0.97 ** np.arange(400)
    m = (u * e) @ u.T
    values, _ = whitening.top_components(lambda v: m @ v, 400)
    assert np.abs(values - e[:8]).max() < 1e-11


def test_deviations_past_a_long_are_exact_or_null(spark):
    held = whitening.Moments(3, [0, 0])
    assert held.deviations(np.array([[1 << 40, -(1 << 40)]])) == [2 * 9 << 80]
    rows = [(1, [4e9, 0.0]), (2, [-4e9, 1.0]), (3, [0.0, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors_of(spark, rows)).collect()}
    assert got[1] is None and set(got) == {1, 2, 3}


def test_queries_have_the_columns_of_the_contract(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op11_alignment(spark, d).columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert queries.op12_whitening(spark, d).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert queries.op13_packing(spark, d).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

"""Periodic runs and whitening against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spokenspark.llm import periodic_runs, whitening

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Every stretch of each period in turn; a stretch is its least period's."""
    ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        edge = np.flatnonzero(np.diff((ids[q:] == ids[:-q]).astype(np.int8), prepend=0, append=0))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(text, doc_id, plant):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=25), st.integers(1, 6)), max_size=8))
def test_runs_of_numbers(parts):
    ids = [x for w, k in parts for x in w * k]
    assert [tuple(r) for r in periodic_runs.runs(np.array(ids, np.int64)).tolist()] == brute_runs(ids)


def test_runs_of_hard_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = [bin(i).count("1") % 2 for i in range(5000)]  # its hashes meet by chance
    for ids in (list(fibonacci[-1]), thue, [0] * 3000, ([0] * 40 + [1]) * 30, list(range(50)) * 3 + list(range(60)) * 2, [0] * 700 + [1] + [0] * 700 + [1] + [0] * 650):
        numbers = np.unique(np.array(ids), return_inverse=True)[1]
        assert [tuple(r) for r in periodic_runs.runs(numbers.astype(np.int64)).tolist()] == brute_runs(ids)
    assert periodic_runs.runs(np.zeros(400_000, np.int64)).tolist() == [[0, 400_000, 1]]  # one run, not one for each multiple


def test_runs_when_hashes_of_words_meet(monkeypatch):
    texts = [[b"w%d" % (i % 50) for i in range(160)], [b"x"] * 13 + [b"y"], []]
    exact = periodic_runs.numbered
    monkeypatch.setattr(periodic_runs, "numbered", lambda t, sure: exact(t, True) if sure else [np.zeros(len(x), np.int64) for x in t])
    assert [[tuple(r) for r in x.tolist()] for x in periodic_runs.runs_of(texts)] == [brute_runs(x) for x in texts]


def test_periodic_runs_of_rows(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(40_000))
    texts = [None, "", " \n\t", "a", "b " * 12, "b " * 11, "a b c d e f " * 2, "x y z q " * 9, "é ü\x0b" * 20 + "end", long_, long_, ("one two " * 30 + "stop ") * 2]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "clash"), (None, texts[4], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3)
    for plant in (False, True):
        got = [tuple(r) for r in periodic_runs.periodic_runs(docs, plant).collect()]
        assert sorted(got, key=str) == sorted((brute_row(t, i, plant) for i, t, _ in rows), key=str)
    spans = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs.where("doc_id = 11"), found=True).collect()}
    assert spans[11] == brute_runs(texts[11].split()) and len(spans[11]) == 3
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = periodic_runs.op11_periodic_runs(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", **{c: "bigint" for c in ("n_runs", "start", "length", "period", "exponent_milli")}, "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == sorted(brute_row(r.text, r.doc_id, True) for r in docs)


def whole(v):
    return np.floor(np.asarray(v, float) * 64).astype(np.int64) + 1_000_000


def test_whitening_of_embeddings(spark):
    given_ = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.array([whole(v) for v in given_.values()])
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = whitening.op13_embedding_whitening(spark, SF).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    deviation = {i: sum(int(v) ** 2 for v in n * row - s) for i, row in zip(given_, x, strict=True)}
    signs = {}
    at = {i: k for k, i in enumerate(given_)}
    for r in rows:
        k = r.component - 1
        w = centred[at[r.vec_id]] @ vectors[:, k] / values[k] ** 0.5
        assert r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-7)
        if abs(w) > 0.1:
            assert signs.setdefault(k, w * r.whitened > 0) == (w * r.whitened > 0)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(3)
    for d, rank, spread in ((1, 1, 0), (5, 5, 0), (12, 4, 0), (20, 20, 12), (33, 30, 6), (6, 0, 0)):
        b = rng.normal(size=(d, rank)) * 10.0 ** -np.linspace(0, spread, max(rank, 1))[:rank]
        a = b @ b.T
        low = whitening.pivoted_cholesky(a)
        assert low.shape[1] <= d and np.allclose(low @ low.T, a, atol=1e-13 * max(1.0, np.abs(a).max()))
        values, vectors = whitening.eigen(a)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13 * d) and (np.diff(values) <= 0).all()
        assert (len(values) == rank or spread) and np.allclose(vectors * values @ vectors.T, a, atol=1e-12 * max(1.0, np.abs(a).max()))
    for n in range(1, 9):
        pairs = [(int(i), int(j)) for a, b in whitening.rounds(n) for i, j in zip(a, b, strict=True)]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]
    # graded: the small eigenvalues keep their digits
    values, _ = whitening.eigen(np.diag([1.0, 1e-8, 1e-16]) + 0.0)
    assert values == pytest.approx([1.0, 1e-8, 1e-16], rel=1e-14)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2, 0.5], [0.9, -0.4, 0.0], [0.3, 0.3, 0.25], [0.3, 0.3, 0.25], [-2.0, 1.0, 7.5]]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 1.0], [1.0, 2.0], [1e30, 1.0, 1.0]]
    rows = [(i, v, "clash", 7) for i, v in enumerate(good + odd)] + [(None, good[0], None, None), (0, good[0], "clash", 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, deviation int").repartition(3)
    model = whitening.fit(df)
    fit = np.array([whole(np.float32(v)) for v in [*good, good[0], good[0]]])
    assert model.n == 7 and [m * 7 + t for m, t in zip(model.near, model.totals, strict=True)] == fit.sum(0).tolist()
    got = whitening.whiten(df, model).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.vec_id is not None) == [(False, i) for i in [0, 0, 1, 2, 3, 4]] and len(got) == 7
    w = np.array([r.whitened for r in got])
    assert np.allclose(w.T @ w / 7, np.eye(w.shape[1]), atol=1e-10) and whitening.identity_error(df, model) < 1e-10
    assert {r.vec_id: r.deviation for r in got}[4] == sum(int(x) ** 2 for x in 7 * fit[4] - fit.sum(0))
    shuffled = whitening.fit(df.repartition(7))  # whole sums: how rows are dealt changes nothing
    assert shuffled.eigenvalues.tolist() == model.eigenvalues.tolist() and shuffled.components.tolist() == model.components.tolist()
    for some in (df.limit(0), df.where("vec_id = 5"), df.where("vec_id = 2")):  # no vector, no valid one, one alone
        m = whitening.fit(some)
        assert len(m.eigenvalues) == 0 and whitening.identity_error(some, m) == 0.0
        assert [r.whitened for r in whitening.whiten(some, m).collect()] == [[]] * m.n
    big = spark.createDataFrame([(i, [(-1.0) ** i * 1e15, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    m = whitening.fit(big)
    rows = whitening.whiten(big, m).collect()
    assert {r.deviation for r in rows} == {None} and whitening.identity_error(big, m) < 1e-6


def test_whitening_drops_dimensions_that_say_nothing(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 3))
    rows = [(i, [*v.tolist(), float(v[0]), 0.5]) for i, v in enumerate(a)]
    m = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(m.eigenvalues) == 3

"""Batch variational LDA on blocks against plain numpy on whole arrays."""

import math

import numpy as np
import pytest

from docvec.operators import blocks as B
from docvec.operators import lda as L
from docvec.operators.special import digamma, lgamma


def test_special_functions():
    x = np.array([1e-3, 0.01, 0.5, 1.0, 2.0, 3.7, 7.99, 8.0, 25.0, 1e4])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5 * x
    slope = [(math.lgamma(v + d) - math.lgamma(v - d)) / (2 * d) for v, d in zip(x, h, strict=True)]
    assert np.allclose(digamma(x), slope, rtol=1e-6, atol=1e-6)
    assert abs(digamma(np.array(1.0)) + 0.5772156649015329) < 1e-13
    assert np.allclose(digamma(x + 1) - digamma(x), 1 / x, rtol=1e-11)


def corpus(seed=0, n=60, terms=40):
    """Documents that draw from one of two halves of the vocabulary, and an empty one."""
    rng = np.random.default_rng(seed)
    m = np.zeros((n, terms))
    for d in range(n):
        half = rng.integers(0, terms // 2, 30) + (terms // 2) * (d % 2)
        np.add.at(m[d], half, 1.0)
    m[7] = 0
    return m


def table(spark, m):
    rows = [(d, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for d, r in enumerate(m)]
    return spark.createDataFrame(rows, "doc_id long, i array<bigint>, v array<double>").repartition(3)


def brute(m, k, steps, seed=0, inner=100, tol=1e-3, start=None):
    """Whole-matrix batch EM; returns (topic weights, mixtures, perplexities)."""
    used = np.flatnonzero(m.sum(axis=0))
    m = m[:, used]
    lam, alpha, eta = L.start_rows(used, k, seed) if start is None else start[used], 1 / k, 1 / k

    def mixes(beta):
        out = np.ones((len(m), k))
        theta = np.exp(digamma(out) - digamma(out.sum(1))[:, None])
        for d in range(len(m)):
            if not m[d].any():
                out[d] = alpha
                continue
            for _ in range(inner):
                new = alpha + theta[d] * ((m[d] / (beta @ theta[d])) @ beta)
                change = np.abs(new - out[d]).mean()
                out[d], theta[d] = new, np.exp(digamma(new) - digamma(new.sum()))
                if change < tol:
                    break
        return out, theta

    perplexity = []
    for _ in range(steps):
        beta = np.exp(digamma(lam) - digamma(lam.sum(0)))
        gamma, theta = mixes(beta)
        norm = theta @ beta.T
        lt, lb = digamma(gamma) - digamma(gamma.sum(1))[:, None], digamma(lam) - digamma(lam.sum(0))
        bound = (m * np.log(norm)).sum() + ((alpha - gamma) * lt + lgamma(gamma)).sum() - lgamma(gamma.sum(1)).sum()
        bound += len(m) * (math.lgamma(alpha * k) - k * math.lgamma(alpha))
        bound += ((eta - lam) * lb + lgamma(lam)).sum() - lgamma(lam.sum(0)).sum()
        bound += k * math.lgamma(eta * len(used)) - k * len(used) * math.lgamma(eta)
        perplexity.append(math.exp(-bound / m.sum()))
        lam = eta + beta * ((m / norm).T @ theta)
    beta = np.exp(digamma(lam) - digamma(lam.sum(0)))
    gamma = mixes(beta)[0]
    return lam, gamma / gamma.sum(1, keepdims=True), perplexity


@pytest.mark.parametrize("limit", [1 << 24, 64])
def test_equals_whole_matrix_em(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "BLOCK_NUMBERS", limit)
    monkeypatch.setattr(L, "LEAST_ENTRIES", 1)
    m = corpus()
    docs = table(spark, m)
    model = L.BatchLDA(k=4, max_iter=5, evaluate_every=1, perp_tol=0.0).fit(docs)
    lam, mix, perplexity = brute(m, 4, 5)
    got = {r["key"]: np.frombuffer(r["row"]) for r in model.topics.collect()}
    assert np.allclose([got[i] for i in sorted(got)], lam, rtol=1e-8)
    shares = {r["doc_id"]: r["vec"] for r in model.transform(docs).collect()}
    assert np.allclose([shares[d] for d in range(len(m))], mix, rtol=1e-8)
    assert np.allclose(shares[7], 0.25)
    assert np.allclose(model.perplexity_, perplexity, rtol=1e-9)
    assert perplexity == sorted(perplexity, reverse=True)


def test_perplexity_ends_the_fit(spark):
    model = L.BatchLDA(k=2, max_iter=50, evaluate_every=1, perp_tol=0.5).fit(table(spark, corpus()))
    assert model.steps_ < 50 and abs(model.perplexity_[-2] - model.perplexity_[-1]) < 0.5


def test_topics_find_the_two_halves(spark):
    m = corpus(3)
    model = L.BatchLDA(k=2, max_iter=20).fit(table(spark, m))
    top = {r["doc_id"]: int(np.argmax(r["vec"])) for r in model.transform(table(spark, m)).collect() if r["doc_id"] != 7}
    assert len({top[d] for d in top if d % 2}) == 1 and len({top[d] for d in top if not d % 2}) == 1 and len(set(top.values())) == 2


def test_unknown_terms_and_empty_corpora(spark):
    m = corpus()
    model = L.BatchLDA(k=3, max_iter=2).fit(table(spark, m))
    odd = spark.createDataFrame([(1, [0, 5000], [2.0, 9.0]), (2, [0], [2.0]), (3, [6000], [1.0]), (4, [], [])],
                                "doc_id long, i array<bigint>, v array<double>")
    got = {r["doc_id"]: r["vec"] for r in model.transform(odd).collect()}
    assert np.allclose(got[1], got[2]) and np.allclose(got[3], 1 / 3) and np.allclose(got[4], 1 / 3)
    none = odd.limit(0)
    assert L.BatchLDA(k=2, max_iter=2).fit(none).transform(none).count() == 0


def test_packing_splits_long_rows(spark):
    rows = [(1, list(range(10)) * 3, "a"), (2, [], "b"), (3, [5, 5], "c"), (4, None, "d")]
    df = spark.createDataFrame(rows, "id long, keys array<bigint>, note string").coalesce(1)
    got = []
    for r in B.packed(df, "keys", 8, split=True).collect():
        import pyarrow as pa
        t = pa.ipc.open_stream(r["rows"]).read_all().to_pylist()
        assert sum(len(x["keys"]) for x in t) <= 8
        got += [(x["id"], x["note"], [r["keys"][p] for p in x["keys"]]) for x in t]
    by = {}
    for i, note, keys in got:
        by.setdefault((i, note), []).extend(keys)
    assert by == {(1, "a"): rows[0][1], (2, "b"): [], (3, "c"): [5, 5], (4, "d"): []}


def test_added_rows_across_batches(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), rng.integers(0, 9, 3).astype(float)) for k in rng.integers(0, 7, 500)]
    df = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in data], "key long, row binary").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["key"]: np.frombuffer(r["row"]) for r in B.added(df, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {k for k, _ in data}:
        assert np.array_equal(got[k], sum(v for key, v in data if key == k))
    assert np.array_equal(B.total(df, 3, lambda m: m.sum(axis=0), 3), sum(v for _, v in data))


def test_faded_topics_leave_the_products(monkeypatch):
    """Same mixtures as with every topic in every step, from fewer numbers."""
    from docvec.operators import lda

    rng = np.random.default_rng(5)
    k, words, docs = 100, 400, 40
    beta = rng.dirichlet(np.full(words, 0.02), k).T + 1e-9
    place = np.concatenate([rng.choice(words, 60, replace=False) for _ in range(docs)])
    offsets, counts = np.arange(docs + 1) * 60, rng.integers(1, 9, docs * 60).astype(float)
    taken = []
    real = lda.digamma
    monkeypatch.setattr(lda, "GROUP_NUMBERS", 1)  # a document each
    monkeypatch.setattr(lda, "digamma", lambda x: taken.append(np.size(x)) or real(x))
    gamma, theta = lda.mixtures(offsets, place, counts, beta, 1 / k, 100, 1e-4)

    steps = 0
    for d in range(docs):
        b, c, g = beta[place[offsets[d]:offsets[d + 1]]], counts[offsets[d]:offsets[d + 1]], np.ones(k)
        for _ in range(100):
            t = np.exp(real(g) - real(g.sum()))
            new = 1 / k + t * ((c / (b @ t + 1e-100)) @ b)
            change, g, steps = np.abs(new - g).mean(), new, steps + 1
            if change < 1e-4:
                break
        np.testing.assert_allclose(gamma[d], g, rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose(theta[d], np.exp(real(g) - real(g.sum())), rtol=1e-6, atol=1e-12)
    assert sum(taken) < 0.8 * steps * k, sum(taken) / steps / k


def test_terms_that_need_a_faded_topic_keep_it():
    from docvec.operators import lda

    k = 4
    beta = np.array([[1.0, 1e-300, 1e-300, 1e-300]] * 3 + [[1e-300, 1.0, 1e-300, 1e-300]])
    gamma, _ = lda.mixtures(np.array([0, 4]), np.arange(4), np.array([900.0, 900.0, 900.0, 1e-3]), beta, 0.001, 30, 1e-12)
    g = np.ones(k)
    for _ in range(30):
        t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
        new = 0.001 + t * ((np.array([900.0, 900.0, 900.0, 1e-3]) / (beta @ t + 1e-100)) @ beta)
        change, g = np.abs(new - g).mean(), new
        if change < 1e-12:
            break
    np.testing.assert_allclose(gamma[0], g, rtol=1e-9)


def test_written_tables_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from docvec.session import FREE_SHUFFLES, dropped, written

    def held():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return {p for d in env.blockManager().diskBlockManager().localDirs() for p in Path(str(d)).rglob("shuffle_*.data")}

    before = held()
    out = written(spark.range(10000).withColumn("k", F.col("id") % 97).groupBy("k").count())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert out.count() == 97
    assert spark.conf.get(FREE_SHUFFLES, "false") != "true"
    dropped(out)

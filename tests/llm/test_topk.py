import numpy as np
import pytest

from docvec.llm import topk


def brute(ids, m, asked, k):
    out = []
    for q in asked:
        i = ids.index(q)
        best = sorted((-int(m[i] @ m[j]), ids[j]) for j in range(len(ids)) if j != i)[:k]
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    return sorted(out)


def brute_rows(rows, asked, k):
    """Every row counts: the queries of one id share its k places."""
    found = {}
    for q, a in rows:
        if asked(q):
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)
    return sorted((q, r + 1, v, -s) for q, x in found.items() for r, (s, v) in enumerate(sorted(x)[:k]))


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2**30, 2**30, 3) // 256]) for i in range(30)]
    rows += [(30 + i, [float(2**22 + i), float(2**21 - i), 1.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(table, table.where("vec_id % 10 = 0"), 5).collect())
    assert got == brute_rows([(i, [int(256 * x) for x in v]) for i, v in rows], lambda i: i % 10 == 0, 5)


def test_huge_components_do_not_end_the_job(spark):
    rows = [(0, [3e38, 1.0]), (1, [1.0, 2.0]), (2, [-3e38, 0.0]), (50, [2.0**40, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.search(table, table.where("vec_id % 50 = 0"), 5).collect()}
    long = 2**63 - 1  # scores at the edge are equal and go by id
    assert got == {(0, 1, 1, long), (0, 2, 50, long), (0, 3, 2, -long - 1),
                   (50, 1, 0, long), (50, 2, 1, 2**48 * 256 - 256 * 512), (50, 3, 2, -long - 1)}


@pytest.mark.parametrize("spread", [1, 3, 40, 400])
def test_index_stops_only_on_proof(spread):
    rng = np.random.default_rng(spread)
    m = rng.integers(-spread, spread + 1, (300, 8)).astype(np.float64)
    ids = np.arange(300) * 7 % 1009
    index = topk.ImpactIndex(ids, m)
    got = {q: list(zip(v.tolist(), s.tolist())) for q, v, s in index.search(ids[:40], m[:40], 5)}
    want = brute(ids.tolist(), m.astype(np.int64), ids[:40].tolist(), 5)
    assert sorted((q, r + 1, v, s) for q, x in got.items() for r, (v, s) in enumerate(x)) == want


def test_rows_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(110)]
    rows += [(0, rows[0][1]), (50, rows[50][1]), (200, None), (250, [0.1, None]), (300, [float("nan")]), (350, [float("inf")]),
             (None, [0.5]), (400, []), (450, [0.3]), (500, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "'x' as part")
    got = sorted(tuple(r) for r in topk.search(table, table.where("vec_id % 50 = 0"), 5).collect())
    clean = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v)))).astype(np.int64).tolist()) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert got == brute_rows(clean, lambda i: i % 50 == 0, 5)
    few = table.where("vec_id in (1, 2, 3)")
    assert topk.search(few, few.where("vec_id = 1"), 5).count() == 2
    empty = table.where("false")
    assert topk.search(empty, empty, 5).count() == 0


def test_query(spark, sf):
    from docvec.llm.queries import QUERIES

    got = sorted(tuple(r) for r in QUERIES["op9_topk"](spark, sf).collect())
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids = t.vec_id.tolist()
    m = [np.floor(256 * np.asarray(v, np.float64)).astype(np.int64) for v in t.embedding]
    assert got == brute(ids, m, [i for i in ids if i % 50 == 0], 5)

import math
from fractions import Fraction

import numpy as np
import pytest

from docvec.llm import whitening


def brute(rows, most=4):
    """rows: (id, list or None): {(place of the row, component): fields} by numpy on whole data."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(256 * float(c)) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    if n < 2:
        return []
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in fit])
    _, s, v = np.linalg.svd(centre, full_matrices=True)
    e, v = np.r_[s * s / n, np.zeros(d - len(s))], v.T
    use = [j for j in range(min(most, d)) if e[j] > 1e-20 * e[0]]
    out = []
    for (i, _), r in zip(kept, x, strict=True):
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)])
        dev = sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))
        out += [(i, j + 1, n, dev if dev < 2**63 else None, c @ v[:, j] / math.sqrt(e[j]), e[j] / e.sum()) for j in use]
    return out


def found(spark, rows, kind="float", most=4):
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n long, x string")
    got = whitening.whiten(df, most)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return [tuple(r) for r in got.collect()]


def compare(got, want, tol=1e-9):
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, abs(r[4]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g[1], np.sign(g[4] * w[4])) == np.sign(g[4] * w[4])
        assert abs(abs(g[4]) - abs(w[4])) < tol * max(1, abs(w[4])) and abs(g[5] / w[5] - 1) < 1e-9 and g[6] < 1e-9


def some(seed, n, d):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 3, d))
    return [(int(i), [float(np.float32(c)) for c in r]) for i, r in enumerate(m)]


def test_equals_numpy_with_repeats_and_bad_rows(spark):
    rows = some(1, 80, 6)
    rows += rows[:7] + [(3, rows[50][1]), (None, rows[4][1]), (200, None), (201, [None] * 6),
                        (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (204, [-0.0] * 6)]
    compare(found(spark, rows), brute(rows))


def test_short_vectors_count_as_padded(spark):
    rows = some(2, 30, 5) + [(90, [0.5, -0.25]), (91, [])]
    compare(found(spark, rows), brute(rows))


def test_ill_conditioned_and_deficient_matrices(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 3))
    scale = np.array([1e6, 1.0, 1e-2])
    wide = np.c_[base * scale, base[:, 0] * 0 + 7, base[:, :1] * 1e6]  # a constant column and a repeated one
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(wide)]
    compare(found(spark, rows, "double", 3), brute(rows, 3), 1e-6)
    got = found(spark, rows, "double", 5)
    assert {r[1] for r in got} == {1, 2, 3} and all(r[6] < 1e-6 for r in got)


def test_no_component_without_variance(spark):
    assert found(spark, [(1, [1.0, 2.0])] * 5) == []
    assert found(spark, [(1, [1.0])][:0]) == []
    assert found(spark, [(1, []), (2, [])]) == []
    assert found(spark, [(1, None)]) == []
    one = found(spark, [(1, [0.0]), (2, [1.0]), (3, [1.0])])
    assert [(r[0], r[1], abs(round(r[4], 12))) for r in sorted(one)] == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_huge_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])]
    got = found(spark, rows, "double")
    assert {(r[0], r[3]) for r in got} == {(1, None), (2, None), (3, 2560**2 + 768**2)} and all(math.isfinite(r[4]) for r in got)


def test_long_that_just_fits():
    m = np.array([[3_000_000_000, 0], [0, 5]], np.int64)
    want = [sum((2 * x - s) ** 2 for x, s in zip(r, [3_000_000_000, 5], strict=True)) for r in m.tolist()]
    assert whitening.deviations(m, 2, [3_000_000_000, 5]) == [x if x < 2**63 else None for x in want]


def test_sums_do_not_overflow(spark):
    big = whitening.LARGEST
    df = spark.createDataFrame([([big, -big, 1],), ([big, -big, -2],)] * 600, "x array<long>")
    assert whitening.column_sums(df, 3) == (1200, [1200 * big, -1200 * big, -600])


def test_triangular_solves():
    rng = np.random.default_rng(4)
    r = np.triu(rng.normal(size=(7, 7))) + 7 * np.eye(7)
    y = rng.normal(size=(20, 7))
    assert np.allclose(whitening.triangular(y @ r, r), y)


@pytest.mark.parametrize("n", [100, 10**9])
def test_factor_of_a_singular_matrix(n):
    a = np.random.default_rng(5).normal(size=(50, 2))
    x = np.c_[a, a @ [1.0, 2.0]]
    g = x.T @ x
    r = whitening.factored(g, n)
    assert np.allclose(r.T @ r, g, atol=1e-6 * np.abs(g).max()) and np.allclose(r, np.triu(r))


def test_query_on_whole_table(spark, sf):
    from docvec.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare([tuple(r) for r in QUERIES["op13_whitening"](spark, sf).collect()], brute(rows))

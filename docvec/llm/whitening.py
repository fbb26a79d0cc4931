"""Embedding whitening by shifted CholeskyQR.

Vectors are quantised to integers; each distinct vector counts once in the
fit.  The centred rows X (n x d) are orthogonalised by Gram passes: a pass
solves the triangular systems found so far for each row, adds up the Gram
matrix of what results, and factors it, G + s I = R' R, with a shift s where G
is not safely positive.  Passes go on until the rows' Gram matrix is a
projector (the identity, for full rank).  Then X = Q R with R = R_k ... R_1 and a
last factor from the Gram matrix of Q itself, and R' R = X' X to double
precision.  The singular value decomposition of R gives the components (right
singular vectors) and eigenvalues s^2 / n of the covariance.

Rows stay distributed; per task one d x d partial goes into an aggregation
by matrix row, and the driver holds d x d matrices only.  Rows are centred in
whole numbers, n x - S, before they are divided and multiplied.

Rows: vectors that are null or hold null or non-finite entries take no part;
repeated rows and repeated ids are each answered; null ids stay null; shorter
vectors count as padded with zeros; entries beyond +-2^53 after quantisation
count as +-2^53 (doubles of that size hold no exact whole number); directions
whose eigenvalue is within rounding of zero give no component, so an empty
table, a single distinct vector or equal vectors give an empty result;
``deviation`` is null where it does not fit a long.  Only (id, vector) are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded, column
from docvec.session import cut_lineage

LARGEST = 1 << 53
BATCH_ROWS = 4096      # rows taken into one matrix product
MAX_PASSES = 12
SETTLED = 1e-7         # a Gram matrix with entries this close to those of its square is a projector
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) of each entry c."""
    c = F.transform(column(vector_col), lambda v: v.cast("double"))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = bounded(vectors).select(column(id_col).cast("long").alias("vec_id"), c.alias("c"), bad.alias("bad"))
    rows = rows.where("c is not null and not bad")
    edge = F.lit(float(LARGEST))
    x = F.transform("c", lambda v: F.floor(F.greatest(-edge, F.least(edge, v * scale))).cast("long"))
    return rows.select("vec_id", x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], d: int, name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded slices of the batches with their vectors as rows of a matrix of d columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            lists = part.column(name)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            if (length == d).all():
                yield part, values.reshape(len(part), d)
            else:
                m = np.zeros((len(part), d), np.int64)
                m[np.arange(d)[None, :] < length[:, None]] = values
                yield part, m


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of the dimensions; halves are added
    apart, so that nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, m in _matrices(batches, d):
            n += len(m)
            high += (m >> 32).sum(axis=0)
            low += (m & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)],
            names=["i", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i int, n long, high long, low long")
    whole = F.expr("sum(cast(high as decimal(28,0))) * 4294967296 + sum(cast(low as decimal(28,0)))")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), whole.alias("s")).orderBy("i").collect()  # d rows
    return int(rows[0]["n"]), [int(r["s"]) for r in rows]


def centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as doubles, each from the exact whole number n x - S."""
    if len(m) and n * max(int(m.max()), -int(m.min()), 1) + max(map(abs, sums)) < LARGEST:
        return (n * m - np.array(sums, np.int64)) / n
    base = np.array([s // n for s in sums], object)      # x - floor(S/n) exactly, then the rest below 1
    rest = np.array([(s - n * int(b)) / n for s, b in zip(sums, base, strict=True)])
    return (m.astype(object) - base).astype(np.float64) - rest


def triangular(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Y with Y R = rows, R upper triangular, by forward substitution over columns."""
    y = np.empty_like(rows)
    for j in range(rows.shape[1]):
        y[:, j] = (rows[:, j] - y[:, :j] @ factor[:j, j]) / factor[j, j]
    return y


def gram(fit: DataFrame, d: int, to_rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of Z' Z over all rows, Z = to_rows(matrix of x): a partial matrix per
    task, its rows added up by Spark; width x width doubles reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, m in _matrices(batches, d):
            z = to_rows(m)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(c.flatten().to_numpy().reshape(-1, width).sum(axis=0) for c in table.column("g").chunks)
        return pa.table({"i": pa.array([key[-1].as_py()], pa.int32()), "g": pa.array([total], pa.list_(pa.float64()))})

    # in two steps, so that no task adds up the partials of all tasks
    parts = fit.select("x").mapInArrow(run, "i int, g array<double>").withColumn("share", F.spark_partition_id() % 16)
    shares = parts.groupBy("share", "i").applyInArrow(add, "i int, g array<double>")
    out = np.zeros((width, width))
    for row in shares.groupBy("i").applyInArrow(add, "i int, g array<double>").collect():
        out[row["i"]] = row["g"]
    return (out + out.T) / 2


def factored(g: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R' R = G + s I.  There is no shift where G is
    well conditioned; else it is that of shifted CholeskyQR,
    11 (n d + d (d + 1)) u |G|, as far as it stays below the square root of u,
    and more only if the factorisation breaks down."""
    d, u = len(g), np.finfo(float).eps / 2
    values = np.linalg.eigvalsh(g)
    if values[0] > 1e-3 * values[-1]:
        return np.linalg.cholesky(g).T
    shift = min(11 * (n * d + d * (d + 1)) * u, u ** 0.5) * values[-1]
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def orthogonalised(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R with R' R = X' X for the centred rows X."""
    factors: list[np.ndarray] = []
    whole = np.eye(d)
    for turn in range(1, MAX_PASSES + 1):
        held = list(factors)

        def solved(m: np.ndarray, held: list[np.ndarray] = held) -> np.ndarray:
            z = centred(m, n, sums)
            for factor in held:
                z = triangular(z, factor)
            return z

        g = gram(fit, d, solved, d)
        if factors and (np.abs(g @ g - g).max() <= SETTLED or turn == MAX_PASSES):
            break
        factors.append(factored(g, n))
        whole = factors[-1] @ whole
    # X' X = whole' G whole holds for the last G measured, whatever a shift has left of it
    values, axes = np.linalg.eigh(g)
    return np.sqrt(np.maximum(values, 0))[:, None] * (axes.T @ whole)


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit components as rows, trace) of the covariance
    from R: at most ``most``, those beyond rounding of zero.  The largest entry
    of a component is positive."""
    _, s, vt = np.linalg.svd(r)
    e = s * s / n
    keep = np.flatnonzero(s > s[0] * 1e-10)[:most] if len(s) and s[0] > 0 else []
    v = vt[keep]
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)]) if len(v) else np.ones(0)
    return e[keep], v * sign[:, None], float(e.sum())


def deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = n * max(int(m.max(initial=0)), -int(m.min(initial=0))) + max(map(abs, sums), default=0)
    if most * most * max(len(sums), 1) <= LONG:
        diff = n * m - np.array(sums, np.int64)
        return (diff * diff).sum(axis=1).tolist()
    out = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in m.tolist()]
    return [x if x <= LONG else None for x in out]


SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component int, n, deviation long, whitened, explained,
    identity_error double): every vector on the ``most`` largest components,
    scaled to variance 1; ``identity_error`` is the largest absolute entry of
    the whitened rows' measured covariance minus the identity."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vector_col)
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], SCHEMA)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    fit = cut_lineage(rows.select(padded.alias("x")).distinct())
    n, sums = column_sums(fit, d)
    if n < 2:
        return spark.createDataFrame([], SCHEMA)
    values, axes, trace = components(orthogonalised(fit, d, n, sums), n, most)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    to = (axes / np.sqrt(values)[:, None]).T  # d x components

    def projected(m: np.ndarray) -> np.ndarray:
        return centred(m, n, sums) @ to

    k = len(values)
    error = float(np.abs(gram(fit, d, projected, k) / n - np.eye(k)).max())
    explained = (values / trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _matrices(batches, d):
            z = projected(m)
            rows_ = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(rows_)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                 pa.array([n] * len(rows_), pa.int64()),
                 pa.array(deviations(m, n, sums), pa.int64()).take(pa.array(rows_)), pa.array(z.ravel()),
                 pa.array(explained * len(m), pa.float64()), pa.array([error] * len(rows_), pa.float64())],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)

"""Exact top-k inner-product search over an impact-ordered index.

Vectors are quantised to integers and dealt into shards.  In a shard the
postings (vector, dimension, impact) are kept in segments by descending
magnitude of the impact.  A block of queries processes the segments score at a
time: after each segment the part of a vector that is still unseen has a known
length, so |unseen part of a score| <= |query| * |unseen vector|.  A query
stops only when at most a few vectors can still be among its k best (their
upper bound reaches the k-th best lower bound); those, and no others, are
rescored exactly.  If the segments run out first, the bounds have become the
scores themselves.

Rows: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; every row counts, also those that repeat an id
(a query meets no row of its own id, and queries of one id share their k
places); shorter vectors count as padded with zeros; an empty table gives an
empty result; ties go to the smaller id.  Scores are exact: where doubles
could round, the bounds allow for it and rescoring is in whole numbers.
Components beyond +-2^62 after quantisation count as +-2^62, and a score beyond
a long as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import column
from docvec.operators.ranking import top_k_per_group
from docvec.session import cut_lineage

SHARD_ROWS = 8192     # vectors in a shard, about
QUERY_ROWS = 1024     # queries in a block, about
CHUNK = 128           # queries scored at once against a shard
LARGEST = 1 << 62
LONG = (1 << 63) - 1
ROUNDING = 1e-12
SEGMENTS = (96, 64, 48, 32, 24, 16, 8, 1)  # smallest impact magnitude of each segment


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id",
              vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>, row): floor(scale * x) of each component x."""
    x = F.transform(column(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), x.alias("x"), bad.alias("bad"))
    rows = rows.where("vec_id is not null and x is not null and not bad")
    edge = F.lit(float(LARGEST))
    v = F.transform("x", lambda c: F.floor(F.greatest(-edge, F.least(edge, c * scale))).cast("long"))
    # rows are dealt by a number of their own, so that copies do not meet in one part
    return rows.select("vec_id", v.alias("v"), F.monotonically_increasing_id().alias("row"))


def _packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """(part int, ids binary, vectors binary, width int): one row per part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            f = pd.concat(held, ignore_index=True)
            width = max(map(len, f["v"]), default=0)
            m = np.zeros((len(f), width), np.int64)
            for i, v in enumerate(f["v"]):
                m[i, :len(v)] = v
            yield pd.DataFrame({"part": [f["part"].iloc[0]], "ids": [f["vec_id"].to_numpy("<i8").tobytes()],
                                "vectors": [m.astype("<i8").tobytes()], "width": [width]})

        for frame in frames:
            for _, group in frame.groupby("part", sort=False):
                if held and held[-1]["part"].iloc[0] != group["part"].iloc[0]:
                    yield from flush()
                    held.clear()
                held.append(group)
        if held:
            yield from flush()

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(min(parts, 4096), "part").sortWithinPartitions("part", "vec_id", "row")
    return dealt.mapInPandas(run, "part int, ids binary, vectors binary, width int")


def _unpacked(ids: bytes, vectors: bytes, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    m = np.zeros((len(keys), to), np.int64)
    m[:, :width] = np.frombuffer(vectors, "<i8").reshape(len(keys), width)
    return keys, m


def _exact(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``m`` with ``q`` in whole numbers."""
    most = int(np.abs(m).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, len(q))
    if most <= LONG:
        return m @ q
    whole = m.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), -LONG - 1), LONG) for x in whole], np.int64)


class ImpactIndex:
    """Segments of one shard: per segment a (dimension x vector) matrix that
    holds the impacts of its postings, and the length of what is unseen after it."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.whole = ids, np.asarray(matrix).astype(np.int64)
        matrix = self.whole.astype(np.float64)
        magnitude = np.abs(matrix)
        self.length = np.sqrt((matrix * matrix).sum(axis=1))
        self.segments, self.unseen = [], []
        upper = np.inf
        for least in SEGMENTS:
            inside = (magnitude >= least) & (magnitude < upper)
            upper = least
            if inside.any():
                self.segments.append(np.ascontiguousarray(np.where(inside, matrix, 0.0).T))
                rest = np.where(magnitude < least, matrix, 0.0)
                self.unseen.append(np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vector ids, exact scores) of the k best, never the
        query's own id."""
        n = len(self.ids)
        asked, queries = np.asarray(queries).astype(np.int64), np.asarray(queries).astype(np.float64)
        length = np.sqrt((queries * queries).sum(axis=1)) * (1 + 1e-9)
        own = q_ids[:, None] == self.ids[None, :]
        seen = np.zeros((len(queries), n))
        open_ = np.arange(len(queries))
        possible: dict[int, np.ndarray] = {}
        for segment, unseen in zip(self.segments, self.unseen, strict=True):
            seen[open_] += queries[open_] @ segment
            # beyond 2^53 sums of doubles round: a share of |query| |vector| covers that
            slack = length[open_, None] * (unseen + ROUNDING * self.length)[None, :]
            lower = np.where(own[open_], -np.inf, seen[open_] - slack)
            upper = np.where(own[open_], -np.inf, seen[open_] + slack)
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
            member = (upper >= kth[:, None]) & ~own[open_]
            done = member.sum(axis=1) <= 4 * k  # proven: no other vector can be among the k best
            for i in np.flatnonzero(done):
                possible[int(open_[i])] = np.flatnonzero(member[i])
            rest, last = open_[~done], member[~done]
            open_ = rest
            if not len(open_):
                break
        else:
            for i, q in enumerate(open_):  # all segments are in: the last bounds are the scores
                possible[int(q)] = np.flatnonzero(last[i]) if self.segments else np.flatnonzero(~own[q])
        for q, members in possible.items():
            scores = _exact(self.whole[members], asked[q])
            best = np.lexsort((self.ids[members], -scores))[:k]
            yield int(q_ids[q]), self.ids[members[best]], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank int, vec_id, score long): for each row of ``queries``
    its k best rows of ``vectors`` by integer inner product, itself excepted.
    Blocks of queries meet shards of the index in tasks of a bounded size."""
    rows = cut_lineage(quantised(vectors, scale, id_col, vector_col))
    asked = cut_lineage(quantised(queries, scale, id_col, vector_col))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    index = _packed(rows, SHARD_ROWS, shards).withColumnRenamed("part", "shard")
    block = _packed(asked, QUERY_ROWS, blocks).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("part").alias("block"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                to = max(r.width, r.q_width)
                index_ = ImpactIndex(*_unpacked(r.ids, r.vectors, r.width, to))
                q_ids, q = _unpacked(r.q_ids, r.q_vectors, r.q_width, to)
                for at in range(0, len(q_ids), CHUNK):
                    found = list(index_.search(q_ids[at:at + CHUNK], q[at:at + CHUNK], k))
                    yield pd.DataFrame({
                        "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                        "vec_id": np.concatenate([f[1] for f in found]),
                        "score": np.concatenate([f[2] for f in found])})

    best = index.hint("merge").join(block, "shard").mapInPandas(run, "query_id long, vec_id long, score long")
    ranked = top_k_per_group(best, ["query_id"], k, [F.desc("score"), F.asc("vec_id")], salts=4)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Quality scores from a generalised additive model with pairwise interactions.

Each text gives a few counts and shares over its whole length.  The model adds
one lookup table per feature and one per chosen pair of features.  Training is
cyclic boosting: round after round each feature in turn gets a small step from
a shallow tree (at most three leaves) over its bins, fitted to the logistic
residual; then the pairs with the largest gain are boosted the same way with
one cut on either axis.  Scoring adds up bin entries.

The texts are read once, for their features; those are written as a narrow
table in `spark.checkpoint.dir`.  Counts cover all texts; the model is fitted
on at most TRAIN_ROWS labelled rows that are not held out (all of them, if
fewer), drawn by a hash of the id.

Rows: a null text counts as empty and gets a score like any other; rows with a
null id are scored but never learned from; a text with several labels is
learned once with each, null labels are left out; repeated rows are scored each
on their own; without labels every score is 0.5, with one class only it is that
class's.  Only (id, text) and (id, label) are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import column, slices, text_rows
from docvec.session import cut_lineage

TRAIN_ROWS = 50_000   # bound on the labelled rows that the model is fitted on
BINS = 48             # of each feature's table
PAIR_BINS = 12        # of either axis of a pair's table
ROUNDS = 120          # cycles over the features
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
PART_BYTES = 1 << 20  # words are taken up in parts of about this size

FEATURES = ("chars", "words", "word_length", "capitals", "digits", "symbols", "exclaims", "pipes", "stops",
            "distinct", "top_word", "repeats", "line_length", "same_lines", "others")

_KIND = np.zeros(256, np.int64)  # of a byte: 1 capital, 2 small, 3 digit, 4 white space, 5 symbol, 6 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (6 if _b > 127 else 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit()
                 else 4 if _c.isspace() else 5)


def text_features(text: bytes) -> list[float]:
    """FEATURES of one whole text.  Words are what white space parts; they are
    counted over the whole text, taken up in parts of PART_BYTES."""
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=histogram, minlength=7)
    n = max(1, len(text))
    letters = max(1.0, kinds[1] + kinds[2])
    words = repeats = at = 0
    counts: Counter = Counter()
    last = None
    while at < len(text):
        end = at + PART_BYTES
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        part = text[at:end].split()
        if part:
            counts.update(part)
            words += len(part)
            repeats += (part[0] == last) + sum(a == b for a, b in zip(part, part[1:]))
            last = part[-1]
        at = end
    distinct, top = len(counts), max(counts.values(), default=0)
    lines = text.count(b"\n") + 1
    different = len(set(text.split(b"\n")))
    w = max(1, words)
    return [np.log1p(len(text)), np.log1p(words), (n - kinds[4]) / w, kinds[1] / letters, kinds[3] / n,
            kinds[5] / n, histogram[33] / w, histogram[124] / w, histogram[46] / w, distinct / w, top / w,
            repeats / w, np.log1p(n / lines), 1 - different / lines, kinds[6] / n]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>): the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [text_features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


# -- the model ------------------------------------------------------------------
@dataclass
class Additive:
    """Bin edges and lookup tables; a score is the sum of one entry of each."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                           np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Per bin, the value of its leaf in a tree over the bins' sums of
    gradients and curvatures, grown leaf by leaf."""
    out = np.zeros(len(g))
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-6, None)
        for i, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
            gain -= cg[-1] ** 2 / (ch[-1] + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (i, a, a + at + 1, b))
        if best[1] is None:
            break
        i, a, cut, b = best[1]
        spans[i:i + 1] = [(a, cut), (cut, b)]
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    quads = [(cg[:-1, :-1], ch[:-1, :-1]), (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]),
             (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1])]
    quads.append((G - sum(q[0] for q in quads), H - sum(q[1] for q in quads)))
    gain = sum(a ** 2 / (b + 1) for a, b in quads) - G ** 2 / (H + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    (out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:]) = (
        a[i, j] / (b[i, j] + 1) for a, b in quads)
    return float(gain[i, j]), out


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit the tables by cyclic boosting on rows ``x`` and labels ``y``."""
    if not len(y):
        return Additive(0.0, [], [], [], [])
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Additive(float(np.log(rate / (1 - rate))), [], [], [], [])
    if len(set(y.tolist())) < 2:
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(d)]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(d)]
    bins = [np.searchsorted(model.edges[f], x[:, f], side="right") for f in range(d)]
    coarse = [np.searchsorted(model.pair_edges[f], x[:, f], side="right") for f in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(d):
            g, h = residual()
            size = len(model.tables[f])
            step = RATE * _step(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            model.tables[f] += step
            total += step[bins[f]]
    shape = [len(e) + 1 for e in model.pair_edges]

    def joint(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = residual()
        cell = coarse[a] * shape[b] + coarse[b]
        size = shape[a] * shape[b]
        gain, leaf = _cross(np.bincount(cell, g, size).reshape(shape[a], -1), np.bincount(cell, h, size).reshape(shape[a], -1))
        return gain, leaf, cell

    gains = sorted(((joint(a, b)[0], a, b) for a in range(d) for b in range(a + 1, d)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            _, leaf, cell = joint(a, b)
            table += RATE * leaf
            total += RATE * leaf.ravel()[cell]
    return model


# -- Spark ------------------------------------------------------------------------
def fit(x: DataFrame, labels: DataFrame, train: str, id_col: str = "doc_id",
        label_col: str = "quality") -> Additive:
    """Model of ``label_col`` (0 or 1) from feature rows that satisfy the SQL
    condition ``train``; at most TRAIN_ROWS of them, drawn by hash."""
    known = labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).cast("int").alias("y"))
    rows = cut_lineage(x.where(train).join(known.where("doc_id is not null and y in (0, 1)"), "doc_id"))
    n = rows.count()
    if n > TRAIN_ROWS:  # a little under the bound, as a hash cannot draw an exact number
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(0.95e6 * TRAIN_ROWS / n))
    found = rows.select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return boost(np.array(found["x"].tolist(), np.float64).reshape(len(found), len(FEATURES)), found["y"].to_numpy(np.float64))


def score(x: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score double) of each feature row, by table additions."""

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(values.tolist(), np.float64).reshape(len(values), len(FEATURES))))

    return x.select("doc_id", scored("x").alias("score"))

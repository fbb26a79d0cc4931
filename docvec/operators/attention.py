"""Attention pooling (E17), feature combination (E19) and the hierarchical
attention document encoders (E18, E20) built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.operators.blocks import Block, narrow_row, on_blocks, packed
from docvec.operators.vocab import bags_of
from docvec.operators.wordvec import BLOCK_WORDS, scale
from docvec.session import written

# The pooling epsilon of the reference layer.
ATTENTION_EPS = 1e-7
TOGETHER = 64   # blocks of bags that get their words' vectors together


def combine(a: Column, b: Column, op: str) -> Column:
    """Element-wise add / mul, or concat, of two vectors."""
    if op == "add":
        return F.zip_with(a, b, lambda x, y: x + y)
    if op == "mul":
        return F.zip_with(a, b, lambda x, y: x * y)
    if op == "concat":
        return F.concat(a, b)
    raise ValueError(f"unknown features operation {op!r}; expected add, mul or concat")


def _pool(df: DataFrame, keys: list, vec_col: str, score: Column, eps: float,
          count_col: str | None = None) -> DataFrame:
    """sum(n exp(s) x) / (sum(n exp(s)) + eps) per key: two partial-aggregated
    sums (n = multiplicity of the row, 1 without ``count_col``)."""
    n = F.col(count_col).cast("double") if count_col else F.lit(1.0)
    return _ratio(df.select(*keys, (n * F.exp(score)).alias("_a"), F.col(vec_col).alias("_x")), keys, eps)


def _ratio(e: DataFrame, keys: list, eps: float) -> DataFrame:
    """sum(a x) / (sum(a) + eps) per key, both sums in one aggregation."""
    sums = e.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("_x"), F.col("_a"))).alias("_num"), F.sum("_a").alias("_den"))
    return sums.select(*keys, scale(F.col("_num"), 1.0 / (F.col("_den") + F.lit(eps))).alias("vec"))


def identity_score(vec_col: str, dim: int) -> Column:
    """tanh(x) . u with u = 1/sqrt(d) in every coordinate (W = I, b = 0)."""
    return F.aggregate(vec_col, F.lit(0.0), lambda acc, x: acc + F.tanh(x)) / F.lit(float(np.sqrt(dim)))


def attention_pool_identity(df: DataFrame, keys: list, dim: int, eps: float = ATTENTION_EPS,
                            vec_col: str = "vec") -> DataFrame:
    """E17 with W = I, b = 0 and u = 1/sqrt(d) in every coordinate: a pure
    column-expression score, so the whole pooling stays in the JVM."""
    return _pool(df, keys, vec_col, identity_score(vec_col, dim), eps)


def bag_attention_pool(counts: DataFrame, scored_words: DataFrame, keys: list, eps: float = ATTENTION_EPS,
                       word_col: str = "word", unknown: float = 0.0, dim: int | None = None) -> DataFrame:
    """E17 over bags of words: the score depends on the word vector only, so
    it is computed once per distinct word (``scored_words(word, vec, s)``);
    documents pool with weight n * exp(s).  Unknown words (no vector) count
    with s = ``unknown`` in the normaliser only.  Bags work in blocks: a word's
    vector travels once to the blocks that work together, not once per document.
    ``counts``: (keys, word, n), or a row per key as ``vocab.bags`` makes them.
    With ``dim`` the words are not read for it, and go straight to the blocks."""
    table = (scored_words.where(F.col("vec").isNotNull()).select(F.col(word_col).alias("key"), "vec", F.exp("s").alias("a")))
    d = dim
    if d is None:
        table = written(table)
        first = table.select(F.size("vec")).first()
        if first is None:
            return written(counts.select(*keys).distinct().withColumn("vec", F.lit(None).cast("array<double>")))
        d = first[0]
    bags = counts if "words" in counts.columns else bags_of(counts, keys, word_col)
    kinds = [(f.name, f.dataType.simpleString()) for f in bags.schema.fields if f.name in keys]

    def run(block: Block) -> pa.Table:
        offsets, place = block.lists("words")
        place, n, (params, times) = place.astype(np.int64), block.lists("n")[1], block.summed()
        a = np.where(times > 0, params[:, d], np.exp(unknown))[place] * n
        out = np.add.reduceat(n[:, None] * params[place, :d], offsets[:-1], axis=0) / (np.add.reduceat(a, offsets[:-1]) + eps)[:, None]
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * d, pa.int32()), pa.array(out.ravel()))
        return pa.table({name: block.table.column(name) for name, _ in kinds} | {"vec": vec})

    # vectors travel as they are, mostly floats, beside their weights
    params = table.select("key", narrow_row(F.concat(F.col("vec").cast("array<double>"), F.array("a"))).alias("row"))
    return on_blocks(packed(bags, "words", BLOCK_WORDS), params, d + 1, run,
                     "".join(f"`{name}` {kind}, " for name, kind in kinds) + "vec array<double>", TOGETHER,
                     lambda rows: np.c_[rows[:, :d] * rows[:, d:], rows[:, d]])


def word_attention_pool(counts: DataFrame, wv: DataFrame, keys: list, W, b, u, eps: float = ATTENTION_EPS,
                        dim: int | None = None) -> DataFrame:
    """E17 as ``attention_pool`` over the words of each key, (keys, word, n) and
    (word, vec): a word is scored once, unknown words as zero vectors."""
    scored = wv.where(F.col("vec").isNotNull()).withColumn("s", attention_scores(W, b, u)(F.col("vec")))
    return bag_attention_pool(counts, scored, keys, eps, unknown=float(np.tanh(np.asarray(b, np.float64)) @ np.asarray(u, np.float64)), dim=dim)


def attention_scores(W: np.ndarray, b: np.ndarray, u: np.ndarray):
    """Arrow-batched score tanh(xW + b) . u for given parameters."""
    W = np.asarray(W, dtype=np.float64)
    b = np.asarray(b, dtype=np.float64)
    u = np.asarray(u, dtype=np.float64)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype="float64")
        X = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(np.tanh(X @ W + b) @ u)

    return score


def attention_pool(df: DataFrame, keys: list, W, b, u, eps: float = ATTENTION_EPS,
                   vec_col: str = "vec") -> DataFrame:
    """a = exp(tanh(xW + b) . u), pooled = sum(a x) / (sum(a) + eps)."""
    return _pool(df, keys, vec_col, attention_scores(W, b, u)(F.col(vec_col)), eps)

"""Word vectors: derivation of the stand-in table, look-up (E1), SIF weights
(E2), weighted sentence and document averages (E3, E5).

Vector sums use ``Summarizer`` on ML vectors: a JVM aggregate with map-side
partial aggregation, so neither the ``d``-fold explode nor a per-document
collect is needed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.operators.blocks import Block, narrow_row, on_blocks, packed
from docvec.session import written

# Smoothing constants of the two SIF variants.
SIF_A = 1e-4
PSIF_A = 0.01


def md5_bucket(col, n) -> Column:
    """First 8 hex digits of md5 as an integer, modulo n."""
    c = F.col(col) if isinstance(col, str) else col
    h = F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))


def derived_word_vectors(words: DataFrame, embeddings: DataFrame, word_col: str = "word",
                         drop_multiple_of: int | None = None, keep: tuple = ()) -> DataFrame:
    """Stand-in word-vector table: the vector of a word is the embedding whose
    ``vec_id = md5_bucket(word) % (max vec_id + 1)``.  With
    ``drop_multiple_of`` words whose hash is divisible by it are unknown.
    Columns of ``words`` named in ``keep`` come along, a row per word then."""
    n = embeddings.agg(F.max("vec_id")).first()[0] + 1
    w = words.select(F.col(word_col).alias("word"), *keep)
    w = w if keep else w.distinct()
    if drop_multiple_of:
        h = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
        w = w.filter(F.pmod(h, F.lit(drop_multiple_of)) != 0)
    w = w.withColumn("vec_id", md5_bucket("word", n))
    emb = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    # embeddings is keyed by vec_id (unique); the join is word-sized
    return w.join(emb, "vec_id").select("word", "vec", *keep)


def lookup(tokens_long: DataFrame, wv: DataFrame, dim: int, word_col: str = "word") -> DataFrame:
    """Left join on the word, zero vector for unknown words, plus a flag."""
    j = tokens_long.join(wv.withColumnRenamed("word", word_col), word_col, "left")
    return j.select(
        *tokens_long.columns,
        F.col("vec").isNotNull().alias("known"),
        F.coalesce(F.col("vec"), F.array_repeat(F.lit(0.0), dim)).alias("vec"),
    )


def sif_weights(freq: DataFrame, a: float = SIF_A) -> DataFrame:
    """Weight a / (a + p(w)) from the corpus probability table."""
    return freq.withColumn("weight", F.lit(a) / (F.lit(a) + F.col("p")))


def scale(vec: Column, w: Column) -> Column:
    return F.transform(vec, lambda x: x * w)


def vector_sum(df: DataFrame, keys: list, vec_col: str, out: str = "vec", weight_col: str | None = None) -> DataFrame:
    """Element-wise sum of an ARRAY<DOUBLE> column per key, optionally
    weighted (sum of w * x, w >= 0): one JVM aggregate with partial
    aggregation, no per-element lambda."""
    if weight_col:
        # zero-weight rows add nothing (and a group of only such rows is left out)
        df = df.filter(F.col(weight_col) > 0)
        agg = Summarizer.sum(array_to_vector(F.col(vec_col)), F.col(weight_col).cast("double"))
    else:
        agg = Summarizer.sum(array_to_vector(F.col(vec_col)))
    return df.groupBy(*keys).agg(vector_to_array(agg).alias(out))


def vector_mean(df: DataFrame, keys: list, vec_col: str, out: str = "vec") -> DataFrame:
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col)))).alias(out))


def sentence_vectors(tok: DataFrame, wv: DataFrame, weights: DataFrame | None, dim: int,
                     id_col: str = "doc_id", min_len: int = 2) -> DataFrame:
    """Per (doc, sentence): sum of weight * vector over known words,
    divided by max(number of words, ``min_len``) (short sentences are padded
    with zero words).  Unseen words weigh 1 (p = 0).

    ``tok`` is the long token table (doc_id, sent_no, pos, word)."""
    counts = tok.groupBy(id_col, "sent_no", "word").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(word_table(wv, weights), "word", "left")
    # unknown words add a zero vector and count in the length
    zeros = F.array_repeat(F.lit(0.0), dim)
    wgt = F.coalesce(F.col("weight"), F.lit(1.0)) * F.col("n")
    sums = j.groupBy(id_col, "sent_no").agg(
        F.sum("n").alias("n_words"),
        vector_to_array(Summarizer.sum(array_to_vector(F.coalesce("vec", zeros)), wgt.cast("double"))).alias("s"))
    denom = F.greatest(F.col("n_words"), F.lit(min_len)).cast("double")
    return sums.select(id_col, "sent_no", "n_words", scale(F.col("s"), 1.0 / denom).alias("vec"))


BLOCK_WORDS = 1 << 17   # words of the documents that work together
TOGETHER = 128          # blocks that get their words' vectors together: the more, the fewer times a word travels


def document_words(df: DataFrame, sentences: Column, tokenize: Callable[[Column], Column], id_col: str = "doc_id") -> DataFrame:
    """(id, words array<string>, lens array<int>): each document's words in
    order, and the sizes of its sentences that have any."""
    t = df.select(id_col, F.transform(sentences, lambda s: tokenize(s)).alias("_t"))
    return t.select(id_col, F.flatten("_t").alias("words"), F.filter(F.transform("_t", F.size), lambda n: n > 0).alias("lens"))


def sentence_means(rows: np.ndarray, lens: np.ndarray, min_len: int = 2) -> np.ndarray:
    """E3 of one document: sums of its words' weighted vectors per sentence,
    over max(number of words, ``min_len``)."""
    starts = np.cumsum(lens) - lens
    return np.add.reduceat(rows, starts, axis=0) / np.maximum(lens, min_len)[:, None]


def sentence_words(df: DataFrame, sentences: Column, tokenize: Callable[[Column], Column], max_sents: int | None = None,
                   id_col: str = "doc_id") -> DataFrame:
    """(id, sent_no, words array<string>): the sentences that have words, those
    of rows with equal ids joined by their number; the sentences of a document
    come to lie together."""
    # texts are dealt out, not words, which take more room
    s = df.repartition(id_col).select(id_col, F.posexplode(sentences).alias("sent_no", "_s"))
    if max_sents is not None:
        s = s.where(F.col("sent_no") < max_sents)
    w = s.select(id_col, "sent_no", tokenize(F.col("_s")).alias("_w"))
    # one sentence per group
    return w.groupBy(id_col, "sent_no").agg(F.flatten(F.collect_list("_w")).alias("words")).where(F.size("words") > 0)


def on_sentences(sents: DataFrame, wv: DataFrame, weights: DataFrame | None, dim: int, min_len: int = 2,
                 finish: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, made: str = "vec array<double>") -> DataFrame:
    """E3 as ``sentence_vectors``, of rows (..., words) that are a sentence each:
    their other columns, n_words and vec.  Sentences work in blocks, as
    documents do, so that no vector travels once per sentence and word.
    ``finish(vectors)`` makes a block's columns ``made`` of them instead: many
    blocks work together if a sentence's vector is not the result."""
    kept = [f for f in sents.schema.fields if f.name != "words"]

    def run(block: Block) -> pa.Table:
        offsets, place = block.lists("words")
        place, (params, times) = place.astype(np.int64), block.summed()
        size = np.add.reduceat(np.maximum(times, 1)[place], offsets[:-1])   # as a join gives them
        out = np.add.reduceat(params[place], offsets[:-1], axis=0) / np.maximum(size, min_len)[:, None]
        if finish is None:
            own = {"vec": pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))}
        else:
            own = {name: pa.array(values) for name, values in finish(out).items()}
        return pa.table({f.name: block.table.column(f.name) for f in kept} | {"n_words": pa.array(size, pa.int64())} | own)

    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return on_blocks(packed(sents, "words", BLOCK_WORDS), _rows(weighed(wv, weights)), dim + 1, run,
                     f"{columns}n_words long, {made}", TOGETHER // 8 if finish is None else TOGETHER, _times_weight)


def _rows(table: DataFrame) -> DataFrame:
    """(key, row) of a table (word, vec, weight); a word without a vector is
    unknown.  Vector and weight travel side by side: the vector's numbers are
    mostly floats, their products with the weight are not."""
    return table.where(F.col("vec").isNotNull()).select(F.col("word").alias("key"), narrow_row(
        F.concat(F.col("vec").cast("array<double>"), F.array(F.col("weight").cast("double")))).alias("row"))


def _times_weight(rows: np.ndarray) -> np.ndarray:
    return rows[:, :-1] * rows[:, -1:]


def on_documents(docs: DataFrame, table: DataFrame, dim: int, fn: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 id_col: str = "doc_id", empty: bool = True) -> DataFrame:
    """(id, vec): ``fn(weighted vectors of the words, sizes of the sentences)``
    of each row of ``docs`` (id, words, lens); zeros for one without words, or
    no row without ``empty`` (a filter before would tokenise every text twice).
    Documents work in blocks: the vector of a word travels once to each block
    that has it, not once per document, sentence and word.

    ``table``: (word, vec, weight); unknown words count as zero vectors."""
    def run(block: Block) -> pa.Table:
        offsets, place = block.lists("words")
        cuts, lens = block.lists("lens")
        place, lens = place.astype(np.int64), lens.astype(np.int64)
        out = np.zeros((len(offsets) - 1, dim))
        for j in range(len(out)):
            if offsets[j] < offsets[j + 1]:
                out[j] = fn(block.params[place[offsets[j]:offsets[j + 1]]], lens[cuts[j]:cuts[j + 1]])
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))
        made = pa.table({id_col: block.table.column(id_col), "vec": vec})
        return made if empty else made.filter(pa.array(np.diff(offsets) > 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return on_blocks(packed(docs, "words", BLOCK_WORDS), _rows(table), dim + 1, run, f"`{id_col}` {kind}, vec array<double>",
                     TOGETHER, _times_weight)


def weighed(wv: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(word, vec, weight) of the words with a vector; words without a weight
    weigh 1 (p = 0).  Without ``weights``, those that ``wv`` has, or 1."""
    if weights is None:
        return wv.select("word", "vec", F.col("weight") if "weight" in wv.columns else F.lit(1.0).alias("weight"))
    w = wv.join(weights.select("word", "weight"), "word", "left")
    return w.select("word", "vec", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def word_table(wv: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``weighed``, materialised: token counts then need one join with a plain
    table, in which Spark can split the rows of a hot word."""
    return written(weighed(wv, weights))


def doc_average(sent_vecs: DataFrame, id_col: str = "doc_id", vec_col: str = "vec") -> DataFrame:
    """E5: document vector = mean of its sentence vectors."""
    return vector_mean(sent_vecs, [id_col], vec_col, "vec")


def long_vectors(df: DataFrame, keys: list, vec_col: str = "vec", digits: int = 6) -> DataFrame:
    """(keys..., dim, value) rows for comparison, values rounded."""
    return df.select(*keys, F.posexplode(vec_col).alias("dim", "value")).withColumn(
        "value", F.round("value", digits))

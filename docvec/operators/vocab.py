"""Vocabulary and document-term aggregations (V1-V10) as long tables.

``dtm(doc_id, term, n)`` is the sparse document-term matrix; nothing here
densifies over the vocabulary.  Corpus-level scalars (number of documents,
number of tokens) are single values brought to the driver by one action.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvec.operators.blocks import Block, on_blocks, packed, row_of
from docvec.operators.ranking import checked_broadcast, global_rank, top_k  # noqa: F401
from docvec.session import cut_lineage, written

BLOCK_WORDS = 1 << 17   # words of the documents that make their grids together
HELD_WORDS = 1 << 20    # words that a task sorts out at a time
TOGETHER = 16           # blocks that get their words' values together
GRIDS = 256             # padded grids that a task holds


def term_counts(df: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """V1 before pruning: (doc_id, term, n).  Map-side partial aggregation
    collapses repeated terms before the shuffle."""
    return (
        df.select(id_col, F.explode(tokens_col).alias("term"))
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bags_of(counts: DataFrame, keys: list, word_col: str = "word") -> DataFrame:
    """(keys, words array, n array<double>): a row per key of its counts."""
    # one bag per group, at most its distinct words
    per = counts.groupBy(*keys).agg(F.collect_list(F.struct(F.col(word_col).alias("w"), F.col("n").cast("double").alias("n"))).alias("_b"))
    return per.select(*keys, F.col("_b.w").alias("words"), F.col("_b.n").alias("n"))


def bags(df: DataFrame, tokenize: Callable[[Column], Column], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, words, n array<double>): a row per id that has words, with the counts
    of its distinct words, written.  Texts are dealt out by id, then nothing else
    is: neither tokens nor counts travel."""
    t = df.select(id_col, text_col).repartition(id_col).select(id_col, tokenize(F.col(text_col)).alias("tokens"))
    # explode would have its filter on the tokens made below the exchange, a second time
    e = t.select(id_col, F.explode_outer("tokens").alias("term")).where("term is not null")
    return written(bags_of(e.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n")), [id_col], "term"))


def words_of(bags: DataFrame) -> DataFrame:
    """(word): the distinct words of ``bags``, sorted out in each task first."""
    def unique(batches):
        held, n = [], 0
        for batch in batches:
            held.append(pc.unique(batch.column(0).flatten()))
            n += len(held[-1])
            if n > HELD_WORDS:
                held = [pc.unique(pa.concat_arrays(held))]
                n = len(held[0])
                if n > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays(held, names=["word"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held))], names=["word"])

    return bags.select("words").mapInArrow(unique, "word string").distinct()


def counts_of(bags: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, word, n) of ``bags``."""
    e = bags.select(id_col, F.explode(F.arrays_zip("words", "n")).alias("_e"))
    return e.select(id_col, F.col("_e.words").alias("word"), F.col("_e.n").cast("long").alias("n"))


def term_stats(dtm: DataFrame) -> DataFrame:
    """Per term: document frequency ``df`` and corpus count ``cf``."""
    return dtm.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").cast("long").alias("cf")
    )


def df_bound(value, n_docs: int) -> float:
    """int = absolute number of documents, float = fraction (int 1 != 1.0)."""
    if isinstance(value, bool):
        raise TypeError("document-frequency bound must be int or float")
    return float(value) if isinstance(value, int) else float(value) * n_docs


def prune_vocab(stats: DataFrame, n_docs: int, max_df=1.0, min_df=1,
                max_features: int | None = None) -> DataFrame:
    """V2/V3: keep terms with min_df <= df <= max_df, then the
    ``max_features`` most frequent (ties by term)."""
    hi, lo = df_bound(max_df, n_docs), df_bound(min_df, n_docs)
    if hi < lo:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    kept = stats.filter((F.col("df") <= F.lit(hi)) & (F.col("df") >= F.lit(lo)))
    if max_features is not None:
        kept = top_k(kept, max_features, [F.desc("cf"), F.asc("term")])
    return kept


def restrict(dtm: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keep only vocabulary terms (semi join; the vocabulary is word-sized)."""
    return dtm.join(vocab.select("term"), "term", "left_semi")


def bag_of_words(tokens_df: DataFrame, max_df=1.0, min_df=1, max_features=None,
                 tokens_col: str = "tokens", id_col: str = "doc_id", n_docs: int | None = None):
    """V1: BOW counts over the pruned vocabulary.  Returns (dtm, vocab).

    The document-term table is read twice (statistics, restriction), so it
    is materialised once in the shared checkpoint folder instead of
    tokenising the corpus twice."""
    dtm = cut_lineage(term_counts(tokens_df, tokens_col, id_col))
    n_docs = n_docs if n_docs is not None else tokens_df.count()
    # materialised: Spark can split a hot term in a join with a table, not with a grouping by that term
    vocab = cut_lineage(prune_vocab(term_stats(dtm), n_docs, max_df, min_df, max_features))
    return restrict(dtm, vocab), vocab


def weighted_terms(tokens_df: DataFrame, max_df=1.0, min_df=1, max_features=None, tokens_col: str = "tokens",
                   id_col: str = "doc_id", n_docs: int | None = None) -> DataFrame:
    """V4 from tokens: one join of the counts with the pruned, materialised
    (term, idf) table does the restriction and the weighting."""
    dtm = cut_lineage(term_counts(tokens_df, tokens_col, id_col))
    n_docs = n_docs if n_docs is not None else tokens_df.count()
    vocab = prune_vocab(term_stats(dtm), n_docs, max_df, min_df, max_features)
    return tfidf(dtm, cut_lineage(idf_table(vocab, n_docs)), id_col)


def idf_table(vocab: DataFrame, n_docs: int, smooth: bool = True) -> DataFrame:
    """idf = ln((1+n)/(1+df)) + 1 (smooth), ln(n/df) + 1 otherwise."""
    if smooth:
        idf = F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0
    else:
        idf = F.log(F.lit(float(n_docs)) / F.col("df")) + 1.0
    return vocab.select("term", idf.alias("idf"))


def tfidf(dtm: DataFrame, idf: DataFrame | None, id_col: str = "doc_id", norm: str | None = "l2") -> DataFrame:
    """V4/V5: weight = n * idf (idf=None: plain tf), L2-normalised per doc.
    The document norm is a window sum over the document's terms, so the join is
    evaluated once."""
    if idf is not None:
        w = dtm.join(idf, "term").select(id_col, "term", (F.col("n") * F.col("idf")).alias("w"))
    else:
        w = dtm.select(id_col, "term", F.col("n").cast("double").alias("w"))
    if norm != "l2":
        return w
    # one document per window: at most its distinct terms
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.withColumn("_norm", length).select(
        id_col, "term", F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(F.lit(0.0)).alias("w"))


def word_frequency(tokens_df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """V6: corpus count and probability of every word."""
    # explode would filter on the tokens first, and so make them twice
    e = tokens_df.select(F.posexplode_outer(tokens_col).alias("_pos", "word")).where("_pos is not null")
    cf = e.groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    cf = cut_lineage(cf)            # word-sized; read by the total and by every later use
    total = cf.agg(F.sum("cf")).first()[0] or 0
    return cf.withColumn("p", F.col("cf") / F.lit(float(max(total, 1))))


def word_ids(freq: DataFrame, word_col: str = "word", count_col: str = "cf",
             id_col: str = "id") -> DataFrame:
    """V7: word -> id by frequency rank (ties by word), ids start at 1; 0 is
    padding.  Global order without a single-partition window."""
    return global_rank(freq, [F.desc(count_col), F.asc(word_col)], id_col)


def sentence_tokens(df: DataFrame, sentences_col: str, tokenize, id_col: str = "doc_id") -> DataFrame:
    """Long table (doc_id, sent_no, pos, word) from an array of sentences and a
    per-sentence tokeniser (a Column -> Column function)."""
    s = df.select(id_col, F.posexplode(sentences_col).alias("sent_no", "sentence"))
    return s.select(id_col, "sent_no", F.posexplode(tokenize(F.col("sentence"))).alias("pos", "word"))


def id_grid_long(tok: DataFrame, ids: DataFrame, max_sents: int = 30, max_words: int = 100,
                 max_id: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """V8 long form: out-of-vocabulary words (and ids >= max_id) dropped,
    positions compacted inside each sentence, at most ``max_words`` per
    sentence and the first ``max_sents`` sentences.  Windows are per
    (doc, sentence): bounded by the sentence length."""
    j = tok.filter(F.col("sent_no") < max_sents).join(ids.select(F.col("word"), F.col("id")), "word")
    if max_id is not None:
        j = j.filter(F.col("id") < max_id)
    w = Window.partitionBy(id_col, "sent_no").orderBy("pos")
    return (
        j.withColumn("k", F.row_number().over(w) - 1)
        .filter(F.col("k") < max_words)
        .select(id_col, "sent_no", F.col("k").alias("pos"), "word", "id")
    )


def documents(df: DataFrame, sentences: Column, tokenize: Callable[[Column], Column], id_col: str = "doc_id") -> DataFrame:
    """(id, texts): a row per id with the tokens of each sentence of each of its
    texts, written: the regex pass runs once, for the counts and for the grid.
    Texts are dealt out by id, not their tokens, which take more room."""
    t = df.repartition(id_col).select(id_col, F.transform(sentences, lambda s: tokenize(s)).alias("_t"))
    return written(t.groupBy(id_col).agg(F.collect_list("_t").alias("texts")))


def tokens_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tokens) of ``documents``; no word lies in two sentences."""
    return docs.select(id_col, F.flatten(F.flatten("texts")).alias("tokens"))


def document_frequency(tokens_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, df) of tokens with a row per id: nothing but terms is shuffled."""
    return tokens_df.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def on_grid(docs: DataFrame, words: DataFrame, values: list[str], fn: Callable, schema: str, max_sents: int = 30,
            max_words: int = 100, id_col: str = "doc_id") -> DataFrame:
    """V8 as ``id_grid_long`` of ``documents``, where they lie: ``fn(block, doc,
    sent, pos, place)`` gets a block's kept tokens (row, sentence, compacted
    position, word) in their order and makes (id, ``schema``).  ``words`` (word,
    values...) is what a kept token must have; a word travels once to each block."""
    kept = F.transform("texts", lambda t: F.slice(t, 1, max_sents))
    rows = docs.select(id_col, F.flatten(F.flatten(kept)).alias("words"),
                       F.flatten(F.transform(kept, lambda t: F.transform(t, F.size))).alias("lens"), F.transform(kept, F.size).alias("parts"))

    def run(block: Block) -> pa.Table:
        place = block.lists("words")[1].astype(np.int64)
        cuts, lens = block.lists("lens")
        texts, parts = block.lists("parts")
        lens, parts = lens.astype(np.int64), parts.astype(np.int64)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)   # of a sentence in its text
        doc = np.repeat(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), lens)
        sent = np.repeat(number, lens)
        pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        order = np.flatnonzero(block.known[place])
        order = order[np.lexsort((pos[order], sent[order], doc[order]))]   # texts of one id are laid over each other
        doc, sent, place = doc[order], sent[order], place[order]
        first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(sent, prepend=-1) != 0))
        pos = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        few = pos < max_words
        return fn(block, doc[few], sent[few], pos[few], place[few])

    table = words.select(F.col("word").alias("key"), row_of(F.array(*[F.col(v).cast("double") for v in values])).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()
    return on_blocks(packed(rows, "words", BLOCK_WORDS), table, len(values), run, f"`{id_col}` {kind}, {schema}", TOGETHER)


def grid_ids(docs: DataFrame, ids: DataFrame, max_sents: int = 30, max_words: int = 100, id_col: str = "doc_id") -> DataFrame:
    """V8 long form of ``documents``: (id, sent_no, pos, word, id)."""
    def rows(block: Block, doc, sent, pos, place) -> pa.Table:
        return pa.table({id_col: block.table.column(id_col).take(pa.array(doc)), "sent_no": pa.array(sent), "pos": pa.array(pos),
                         "word": block.keys.take(pa.array(place)), "id": pa.array(block.params[place, 0].astype(np.int64))})

    return on_grid(docs, ids, ["id"], rows, "sent_no long, pos long, word string, id long", max_sents, max_words, id_col)


def grid_features(docs: DataFrame, words: DataFrame, norm: str | None = "l2", max_sents: int = 30, max_words: int = 100,
                  id_col: str = "doc_id") -> DataFrame:
    """V9: (id, sent_no, pos, w) of every kept token: its count among the
    document's kept tokens times ``idf`` of ``words`` (word, idf), over their L2 norm."""
    def rows(block: Block, doc, sent, pos, place) -> pa.Table:
        pair, back, n = np.unique(doc * (len(block.keys) + 1) + place, return_inverse=True, return_counts=True)
        of, word = np.divmod(pair, len(block.keys) + 1)
        w = n * block.params[word, 0]
        if norm == "l2":
            length = np.sqrt(np.bincount(of, w * w, minlength=len(block.table)))[of]
            w = np.divide(w, length, out=np.zeros(len(w)), where=length > 0)
        return pa.table({id_col: block.table.column(id_col).take(pa.array(doc)), "sent_no": pa.array(sent), "pos": pa.array(pos),
                         "w": pa.array(w[back].astype(np.float64))})

    return on_grid(docs, words, ["idf"], rows, "sent_no long, pos long, w double", max_sents, max_words, id_col)


def id_grid(docs: DataFrame, ids: DataFrame, max_sents: int = 30, max_words: int = 100, id_col: str = "doc_id") -> DataFrame:
    """V8 nested form ARRAY<ARRAY<INT>> of ``documents``, padded with 0; a
    document without a known word has no row."""
    def rows(block: Block, doc, sent, pos, place) -> pa.Table:
        some, first = np.unique(doc, return_index=True)
        offsets = pa.array(np.append(first, len(doc)), pa.int32())
        cells = {"at": sent * max_words + pos, "ids": block.params[place, 0]}
        return pa.table({id_col: block.table.column(id_col).take(pa.array(some))} | {
            c: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for c, v in cells.items()})

    def padded(batches):
        for batch in batches:
            for a in range(0, len(batch), GRIDS):
                part = batch.slice(a, GRIDS)
                at, ids_ = part.column(1), part.column(2)
                grid = np.zeros((len(part), max_sents * max_words), np.int32)
                of = np.repeat(np.arange(len(part)), at.value_lengths().to_numpy(zero_copy_only=False))
                grid[of, at.flatten().to_numpy()] = ids_.flatten().to_numpy()
                lines = pa.ListArray.from_arrays(pa.array(np.arange(len(part) * max_sents + 1) * max_words, pa.int32()), pa.array(grid.ravel()))
                nested = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * max_sents, pa.int32()), lines)
                yield pa.RecordBatch.from_arrays([part.column(0), nested], names=[id_col, "grid"])

    found = on_grid(docs, ids, ["id"], rows, "at array<int>, ids array<int>", max_sents, max_words, id_col)
    return found.mapInArrow(padded, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, grid array<array<int>>")


def fixed_length(ids: DataFrame, ids_col: str, n: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Truncate / pad to n, attention mask, first position global."""
    t = F.slice(F.col(ids_col), 1, n)
    pad = F.greatest(F.lit(0), F.lit(n) - F.size(t))
    return ids.select(
        id_col,
        F.concat(t, F.array_repeat(F.lit(0), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(t)), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.lit(n - 1))).alias("global_attention_mask"),
    )

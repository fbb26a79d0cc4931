"""Dictionary steps of the token pipeline with dictionaries given as tables
(T5, T10, T12, T13): joins on the word instead of literal maps, so a
dictionary may have any size.

Tables: ``contractions(form, expansion)``, ``phrases(words ARRAY<STRING>)``,
``stopwords(word)``, ``lemmas(form, pos, lemma)`` with pos n, v or a.  A
document's words are gathered again per document, so the groups are bounded by
a document's length."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.functions import text as T
from docvec.operators.blocks import packed, pull

MERGED = 256            # documents whose words a task holds as Python objects
BLOCK_WORDS = 1 << 17   # words of the documents that look their words up together


def _words(df: DataFrame, arr, id_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(arr).alias("pos", "w"))


def _gathered(df: DataFrame, words: DataFrame, id_col: str, out: str) -> DataFrame:
    """(id, out): the words of each document in order, empty where none is left."""
    per = words.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("_p"))
    none = F.expr("cast(array() as array<string>)")
    return df.select(id_col).join(per, id_col, "left").select(id_col, F.coalesce(F.col("_p.w"), none).alias(out))


def _one_each(table: DataFrame, value: str) -> DataFrame:
    """(w, value): one row per form, so that a form listed again does not
    double words; of several values the first by bytes holds."""
    return table.where(F.col(value).isNotNull()).groupBy(F.col("form").alias("w")).agg(F.min(value).alias(value))


def _translated(df: DataFrame, words: Column, table: DataFrame, id_col: str, out: str) -> DataFrame:
    """(id, out): the words of each row in order, those that ``table`` (w, value)
    has replaced.  Rows work in blocks that look a word up once.  Rows of equal
    ids get the words of all of them by place, rows without an id none, as the
    joins by word and by id gave them."""
    blocks = packed(df.select(id_col, words.alias("words")), "words", BLOCK_WORDS)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, rows = _whole(left.column("keys")).flatten(), pa.ipc.open_stream(left.column("rows")[0].as_py()).read_all()
        at = pc.index_in(keys, value_set=_whole(right.column("key")))
        new = pc.coalesce(_whole(right.column("row")).take(at), keys)
        lists = _whole(rows.column("words"))
        return pa.table({id_col: rows.column(id_col), "w": pa.ListArray.from_arrays(lists.offsets, new.take(lists.values))})

    kind = df.schema[id_col].dataType.simpleString()
    asked = pull(blocks, table.select(F.col("w").alias("key"), F.col("value").alias("row")))
    found = blocks.groupBy("block").cogroup(asked.groupBy("to")).applyInArrow(run, f"`{id_col}` {kind}, w array<string>")
    per = found.groupBy(id_col).agg(F.collect_list("w").alias("_r"))   # one document per group
    placed = F.transform("_r", lambda r: F.transform(r, lambda w, i: F.struct(i.alias("pos"), w.alias("w"))))
    together = F.transform(F.sort_array(F.flatten(placed)), lambda p: p["w"])
    merged = F.when(F.col(id_col).isNull(), F.expr("cast(array() as array<string>)")).when(
        F.size("_r") == 1, F.element_at("_r", 1)).otherwise(together)
    return per.select(id_col, merged.alias(out), F.size("_r").alias("_n")).select(
        id_col, F.explode(F.array_repeat(out, F.col("_n"))).alias(out))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def expand_contractions(df: DataFrame, contractions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T5: (id, text) of the default alphabet in lower case, contracted forms
    replaced word by word; the tokeniser comes after it."""
    t = F.lower(T.keep_chars(T.strip_email(text_col), "default"))
    table = _one_each(contractions, "expansion").withColumnRenamed("expansion", "value")
    return _translated(df, F.split(t, " "), table, id_col, "_w").select(id_col, F.array_join("_w", " ").alias(text_col))


def remove_stopwords(df: DataFrame, stopwords: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, tokens) without the listed words."""
    words = _words(df, F.col(tokens_col), id_col).join(stopwords.select(F.col("word").alias("w")), "w", "left_anti")
    return _gathered(df, words, id_col, tokens_col)


def lemmatize(df: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Noun, then verb, then adjective look-up; unknown forms unchanged.
    The look-ups follow each other in the dictionary, so that a document's words
    meet it once."""
    table = lemmas.where(F.col("pos").isin("n", "v", "a") & F.col("lemma").isNotNull()).select(F.col("form").alias("w")).distinct()
    table = table.withColumn("value", F.col("w"))
    for pos in ("n", "v", "a"):
        known = _one_each(lemmas.where(F.col("pos") == pos), "lemma").withColumnRenamed("w", "value")
        table = table.join(known, "value", "left").select("w", F.coalesce("lemma", "value").alias("value"))
    return _translated(df, F.col(tokens_col), table, id_col, tokens_col)


def merge_phrases(df: DataFrame, phrases: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Consecutive tokens that form a listed phrase become one space-joined
    token; longer phrases first, then in their order, left to right, no overlap.
    Matches are found by joining the documents' runs of words with the phrases;
    only documents with matches are resolved one by one."""
    listed = phrases.select(F.array_join("words", " ").alias("phrase"), F.size("words").alias("n")).distinct().where("n > 1")
    lengths = sorted(r[0] for r in listed.select("n").distinct().collect())  # the few lengths of phrases
    if not lengths:
        return df.select(id_col, tokens_col)

    def runs_of(n: int):
        last = F.size(tokens_col) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(
            i.alias("pos"), F.array_join(F.slice(tokens_col, i + 1, n), " ").alias("phrase")))).otherwise(
            F.expr("cast(array() as array<struct<pos:int,phrase:string>>)"))

    runs = F.flatten(F.array(*[runs_of(n) for n in lengths]))
    found = df.select(id_col, F.explode(runs).alias("r")).select(id_col, "r.pos", "r.phrase").join(listed, "phrase")
    per = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("rank"), F.split("phrase", " ").alias("words"), "pos"))).alias("_m"))

    j = df.select(id_col, tokens_col).join(per.select(id_col, F.transform("_m", lambda m: F.struct(
        m["pos"].alias("start"), (m["pos"] - m["rank"]).alias("end"))).alias("_m")), id_col, "left")
    return j.mapInArrow(_merged, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{tokens_col}` array<string>")


def _merged(batches):
    """(id, tokens) of (id, tokens, matches in their order); MERGED documents at
    a time are Python objects, whatever a batch holds."""
    for batch in batches:
        for a in range(0, len(batch), MERGED):
            part = batch.slice(a, MERGED)
            out = []
            for t, ms in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if ms is None:
                    out.append(t)
                    continue
                taken, head = [False] * len(t), {}
                for m in ms:
                    s, e = m["start"], m["end"]
                    if not any(taken[s:e]):
                        taken[s:e] = [True] * (e - s)
                        head[s] = e
                words, i = [], 0
                while i < len(t):
                    e = head.get(i, i + 1)
                    words.append(" ".join(t[i:e]))
                    i = e
                out.append(words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.string()))], names=batch.schema.names[:2])

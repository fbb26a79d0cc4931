"""Vocabulary, TF-IDF, ranking and split properties."""

import math

from pyspark.sql import functions as F

from docvec.operators import splits, vocab
from docvec.operators.ranking import global_rank, top_k_per_group


def test_global_rank_dense_and_ordered(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    r = global_rank(df, [F.desc("k"), F.col("id")], "rank").collect()
    by_rank = sorted(r, key=lambda x: x["rank"])
    assert [x["rank"] for x in by_rank] == list(range(1, 1001))
    assert [x["k"] for x in by_rank] == sorted((x["k"] for x in r), reverse=True)


def test_kfold_sizes_match_ntile(spark):
    df = spark.range(0, 23).withColumnRenamed("id", "doc_id")
    f = splits.kfold(df, 5, "doc_id").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [5, 5, 5, 4, 4]
    # fewer rows than folds
    g = splits.kfold(spark.range(0, 3).withColumnRenamed("id", "doc_id"), 5, "doc_id").collect()
    assert sorted(r["fold"] for r in g) == [1, 2, 3]


def test_holdout_zero_rows_keeps_training(spark):
    df = spark.range(0, 5).withColumnRenamed("id", "doc_id")
    h = splits.holdout(df, 0.1, 42, "doc_id").collect()
    assert all(r["split"] == "train" for r in h) and len(h) == 5


def test_balance_down_and_up(spark):
    rows = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(3)] + [(200, "c")]
    df = spark.createDataFrame(rows, "doc_id long, target string")
    down = splits.balance(df, "target", 42, "doc_id").groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in down} == {"a": 1, "b": 1, "c": 1}
    up = splits.balance(df, "target", 42, "doc_id", upsampling=True).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in up} == {"a": 10, "b": 10, "c": 10}


def test_tfidf_unit_norm_and_partition_invariance(spark, sf):
    from docvec.functions.text import preprocess
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toks = docs.select("doc_id", preprocess("text").alias("tokens"))
    n = toks.count()
    dtm, voc = vocab.bag_of_words(toks, 0.95, 1, n_docs=n)
    w = vocab.tfidf(dtm, vocab.idf_table(voc, n))
    norms = w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, rel_tol=1e-9) for r in norms)
    w1 = {(r[0], r[1]): r[2] for r in w.collect()}
    toks8 = toks.repartition(8)
    dtm8, voc8 = vocab.bag_of_words(toks8, 0.95, 1, n_docs=n)
    w8 = {(r[0], r[1]): r[2] for r in vocab.tfidf(dtm8, vocab.idf_table(voc8, n)).collect()}
    assert w1.keys() == w8.keys() and all(math.isclose(w1[k], w8[k], rel_tol=1e-12) for k in w1)


def test_max_df_int_vs_float(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 5)], "term string, df long, cf long")
    assert {r[0] for r in vocab.prune_vocab(df, 3, max_df=1).collect()} == {"a"}
    assert {r[0] for r in vocab.prune_vocab(df, 3, max_df=1.0).collect()} == {"a", "b", "c"}


def test_top_k_per_group_skewed(spark):
    rows = [("hot", i, float(i)) for i in range(500)] + [("cold", i, float(-i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    top = top_k_per_group(df, ["g"], 3, [F.desc("v"), F.asc("id")], salts=16).collect()
    got = sorted((r["g"], r["rank"], r["id"]) for r in top)
    assert got == [("cold", 1, 0), ("cold", 2, 1), ("cold", 3, 2), ("hot", 1, 499), ("hot", 2, 498), ("hot", 3, 497)]


def test_splits_keep_rows_with_null_and_repeated_ids(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "b", "x"), (None, "c", "y"), (None, "d", "y"), (2, "e", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    for split in (lambda d: splits.kfold(d, 3), lambda d: splits.holdout(d, 0.34), splits.positional_split):
        got = split(df)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(df.columns).collect())) == sorted(map(key, rows))
    assert sorted(r["n"] for r in splits.kfold(df, 3).groupBy("fold").agg(F.count("*").alias("n")).collect()) == [2, 2, 2]


def test_null_labels_are_no_class_and_keep_their_rows(spark):
    from docvec.sources.corpus import from_table

    df = spark.createDataFrame([(1, "t", "b"), (2, "t", None), (3, "t", "a"), (4, "t", "b")], "doc_id long, text string, lang string")
    indexed = splits.label_index(df, "lang")
    assert {r["doc_id"]: r["target"] for r in indexed.collect()} == {1: 1, 2: None, 3: 0, 4: 1}
    hot = splits.one_hot(indexed, "target")
    assert {r["doc_id"]: r["onehot"] for r in hot.collect()} == {1: [0, 1], 2: [0, 0], 3: [1, 0], 4: [0, 1]}
    assert {r["doc_id"]: r["target"] for r in from_table(df, "doc_id", "text", "lang").collect()} == {1: 1, 2: None, 3: 0, 4: 1}


def test_grid_in_blocks_equals_the_long_form(spark, monkeypatch):
    from docvec.functions import text as T

    monkeypatch.setattr(vocab, "BLOCK_WORDS", 9)
    monkeypatch.setattr(vocab, "GRIDS", 2)
    rows = [(1, "One two one. Two two three four! Five six"), (2, None), (3, "!!! ... One"), (4, "six. six. six. seven seven"), (5, "nobody"),
            (7, "One two. three"), (7, "One two. three"), (None, "one six"), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    docs = vocab.documents(d, T.sentences("text"), T.preprocess)
    assert docs.count() == 7 and sorted(len(r["texts"]) for r in docs.collect()) == [1, 1, 1, 1, 1, 2, 2]
    toks = d.select("doc_id", T.preprocess("text").alias("tokens"))
    freq = vocab.word_frequency(vocab.tokens_of(docs))
    assert sorted(freq.select("word", "cf").collect()) == sorted(vocab.word_frequency(toks).select("word", "cf").collect())
    ids = vocab.word_ids(freq).where("word <> 'nobody'")
    tok = vocab.sentence_tokens(d.select("doc_id", T.sentences("text").alias("s")), "s", T.preprocess)
    long_form = vocab.id_grid_long(tok, ids, 3, 2)
    key = lambda r: tuple(str(x) for x in r)
    columns = ["doc_id", "sent_no", "pos", "word", "id"]
    got = vocab.grid_ids(docs, ids, 3, 2)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(map(tuple, long_form.select(columns).collect()), key=key)
    # every token was a row that was sorted within its sentence before
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()

    idf = vocab.idf_table(vocab.document_frequency(vocab.tokens_of(docs)), len(rows))
    assert sorted(idf.collect()) == sorted(vocab.idf_table(vocab.term_stats(vocab.term_counts(toks)), len(rows)).collect())
    known = long_form.where("doc_id is not null")
    kept = known.groupBy("doc_id", F.col("word").alias("term")).count().withColumnRenamed("count", "n")
    w = vocab.tfidf(kept, idf).withColumnRenamed("term", "word")
    want = {(r["doc_id"], r["sent_no"], r["pos"]): r["w"] for r in known.join(w, ["doc_id", "word"]).collect()}
    words = ids.join(idf.withColumnRenamed("term", "word"), "word")
    found = vocab.grid_features(docs.where("doc_id is not null"), words, "l2", 3, 2).collect()
    assert len(found) == len(want) and all(abs(want[r["doc_id"], r["sent_no"], r["pos"]] - r["w"]) < 1e-12 for r in found)

    cells = {}
    for r in long_form.collect():
        cells.setdefault(r["doc_id"], [[0, 0] for _ in range(3)])[r["sent_no"]][r["pos"]] = r["id"]
    assert {r["doc_id"]: r["grid"] for r in vocab.id_grid(docs, ids, 3, 2).collect()} == cells

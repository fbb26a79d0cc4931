"""Learned methods beat the majority class; fitted methods survive a round trip."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docvec.operators import embedders as E
from docvec.operators.doc2vec import Doc2Vec
from docvec.operators.han import HierarchicalAttention
from docvec.operators.svm import LinearSVM


@pytest.fixture(scope="module")
def corpus(spark, sf):
    from docvec.sources.corpus import from_table
    from docvec.session import cut_lineage

    return cut_lineage(from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "lang"))


@pytest.fixture(scope="module")
def wv(spark, sf):
    from docvec.functions.text import preprocess
    from docvec.operators.wordvec import derived_word_vectors
    from docvec.session import cut_lineage

    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(preprocess("text")).alias("word"))
    return cut_lineage(derived_word_vectors(words, spark.read.parquet(f"{sf}/embeddings.parquet")))


def vectors(method, corpus):
    rows = method.transform(corpus).join(corpus.select("doc_id", "target"), "doc_id").select(
        "doc_id", "target", vector_to_array("features").alias("v")).orderBy("doc_id").collect()
    return np.array([r["v"] for r in rows]), np.array([r["target"] for r in rows])


def held_out_accuracy(x, y):
    train = np.arange(len(y)) % 2 == 0
    centres = np.stack([x[train & (y == c)].mean(0) for c in np.unique(y)])
    x, centres = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12) for a in (x, centres))
    return (np.unique(y)[(x @ centres.T).argmax(1)] == y)[~train].mean(), np.bincount(y).max() / len(y)


@pytest.mark.parametrize("dm", [True, False])
def test_doc2vec_tells_languages(corpus, dm):
    x, y = vectors(Doc2Vec(size=32, epochs=8, dm=dm).fit(corpus), corpus)
    right, majority = held_out_accuracy(x, y)
    assert np.isfinite(x).all() and right > majority + 0.2


def test_doc2vec_blocks_are_bounded_and_follow_the_input(corpus, monkeypatch):
    """Twice the input gives about twice the blocks, none of them larger."""
    from docvec.operators import blocks as B

    seen = []
    packed = B.packed
    monkeypatch.setattr(B, "packed", lambda *a, **k: seen.append(packed(*a, **k)) or seen[-1])
    monkeypatch.setattr("docvec.operators.doc2vec.dropped", lambda *a: None)
    double = corpus.unionByName(corpus.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    for c in (corpus, double):
        Doc2Vec(size=4, epochs=1, dm=False, block_words=2000).fit(c)
    sizes = [[len(r["keys"]) for r in b.select("keys").collect()] for b in seen]
    assert max(max(s) for s in sizes) <= 2000 and len(sizes[0]) > 16
    assert 1.5 * len(sizes[0]) < len(sizes[1]) < 2.5 * len(sizes[0])


def test_doc2vec_blocks_fetch_rows_together(corpus, monkeypatch):
    """A group gets each row once, and its size does not change what is learned."""
    from docvec.operators import doc2vec as D

    spark, got = corpus.sparkSession, []
    small = corpus.where("doc_id < 30")
    for words in (4000, 1 << 21):
        monkeypatch.setattr(D, "GROUP_WORDS", words)
        m = Doc2Vec(size=4, epochs=1, dm=False, block_words=1000, pool=500).fit(small)
        got.append({r["key"]: np.frombuffer(r["row"]) for r in m.params.collect()})
    assert got[0].keys() == got[1].keys() and all(np.allclose(got[0][k], got[1][k], atol=1e-12) for k in got[0])
    # blocks of a group that share their words send them once
    blocks = spark.createDataFrame([(j, bytearray(), [0, 1]) for j in range(64)], "block long, rows binary, keys array<bigint>")
    m = Doc2Vec(size=4, negative=0, block_words=1 << 15)
    grouped = m._grouped(blocks)
    groups = grouped.select("group").distinct().count()
    assert groups <= spark.sparkContext.defaultParallelism < 64
    params = spark.createDataFrame([(k, bytearray(8 * 8)) for k in (0, 1)], "key long, row binary")
    seen = m._on_blocks(grouped, params, lambda block, *rest: block.number, lambda _, keys: D.pa.table(
        {"n": D.pa.array([len(keys)], D.pa.int64())}), "n long")
    assert [r["n"] for r in seen.collect()] == [2] * groups


def test_doc2vec_negatives_follow_the_corpus_counts(corpus):
    m = Doc2Vec(size=4, epochs=0, pool=20_000).fit(corpus)
    one = corpus.sparkSession.createDataFrame([(5, bytearray(), [0])], "block long, rows binary, keys array<bigint>")
    got = {r["key"]: r["times"] for r in m._pools(one).collect()}
    counts = {r["id"]: r["cf"] ** 0.75 for r in m.vocab.collect()}
    whole = sum(counts.values())
    assert sum(got.values()) == 20_000
    for word in sorted(counts, key=counts.get)[-5:]:
        want = 20_000 * counts[word] / whole
        assert abs(got.get(word, 0) - want) < 6 * want ** 0.5


def test_doc2vec_options(corpus):
    small = corpus.where("doc_id < 30")
    for options in ({"context": "sum"}, {"max_step_norm": None, "alpha": 0.005}, {"tag_col": "doc_id"}):
        m = Doc2Vec(size=8, epochs=2, sync_every=1, **options).fit(small)
        assert np.isfinite(vectors(m, small)[0]).all()
    with pytest.raises(ValueError):
        Doc2Vec(context="max")


def test_attention_encoder_learns(corpus, wv):
    """Word vectors that carry the language, as trained ones would."""
    target = corpus.select("doc_id", "target", F.explode(E.T.preprocess("text")).alias("word"))
    most = target.groupBy("word").agg(F.mode("target").alias("c"))
    told = wv.join(most, "word").select("word", F.transform(
        "vec", lambda x, i: x + F.when(i == F.col("c"), 1.0).otherwise(0.0)).alias("vec"))
    m = HierarchicalAttention(told, 64, max_sents=10, max_words=30, epochs=25, lr=0.003, docs_per_partition=64).fit(corpus)
    x, y = vectors(m, corpus)
    pred = (x @ m.params["Wc"] + m.params["bc"]).argmax(1)
    assert (pred == y).mean() > np.bincount(y).max() / len(y) + 0.2


@pytest.mark.parametrize("features, operation", [("bow", "mul"), ("tf", "concat"), ("tfidf", "add")])
def test_token_features(corpus, wv, features, operation):
    small = corpus.where("doc_id < 40")
    m = HierarchicalAttention(wv, 64, 5, 10, features, operation, epochs=1, docs_per_partition=20).fit(small)
    assert np.isfinite(vectors(m, small)[0]).all()


def test_save_and_load(spark, corpus, wv):
    root = tempfile.mkdtemp(prefix="docvec-save-")
    small = corpus.where("doc_id < 60")
    made = {
        "bow": (E.BOW(), E.BOW()), "tfidf": (E.TFIDF(), E.TFIDF()),
        "lsa": (E.LSA(k=5, n_iter=1), E.LSA()), "lda": (E.LDA(k=4, max_iter=2), E.LDA()),
        "sif": (E.SIF(wv, 64), E.SIF(None, 64)), "psif": (E.PSIF(wv, 64, 6, max_iter=2, out_dim=8), E.PSIF(None, 64)),
        "d2v": (Doc2Vec(size=8, epochs=2), Doc2Vec()),
        "han": (HierarchicalAttention(wv, 64, 5, 10, epochs=1), HierarchicalAttention(None, 64)),
    }
    for name, (method, fresh) in made.items():
        path = os.path.join(root, name)
        x, y = vectors(method.fit(small), small)
        method.save(spark, path)
        assert np.allclose(vectors(fresh.load(spark, path), small)[0], x, atol=1e-9), name
    svm = LinearSVM().fit(E.BOW().fit(small).sparse(small).select("doc_id", F.struct("i", "v").alias("f")).join(
        small.select("doc_id", "target"), "doc_id"), "f")
    svm.save(spark, os.path.join(root, "svm"))
    again = LinearSVM.load(spark, os.path.join(root, "svm"))
    assert sorted(again.weights.collect()) == sorted(svm.weights.collect()) and again.classes_ == svm.classes_


def test_hyperparameters_are_checked():
    assert E.BOW().set_hyperparameters(max_df=0.5).max_df == 0.5
    with pytest.raises(ValueError, match="max_dff"):
        E.BOW().set_hyperparameters(max_dff=0.5)


def test_hot_word_join_is_split(spark):
    """With low thresholds Spark splits the rows of a hot word in the one join."""
    from docvec.operators.wordvec import sentence_vectors

    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # a partition is split between its map outputs
    tok = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("doc_id"), F.lit(0).alias("sent_no"), F.lit(0).alias("pos"),
        F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), (F.col("id") % 500).cast("string"))).alias("word"))
    words = spark.range(500).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word")).union(
        spark.createDataFrame([("the",)], "word string"))
    table = words.select("word", F.array(F.lit(1.0), F.length("word").cast("double")).alias("vec"))
    plain = sentence_vectors(tok, table, None, 2).agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))).first()[0]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = sentence_vectors(tok, table, None, 2)
        assert out.agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))).first()[0] == pytest.approx(plain)
        out.write.format("noop").mode("overwrite").save()
        q = out._jdf.queryExecution()
        out.collect()
        assert "skew=true" in q.executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sentences_in_blocks_equal_the_join(spark, monkeypatch):
    """Also for ids that come twice, and without a vector per sentence and word in a shuffle."""
    from docvec.functions import text as T
    from docvec.operators import vocab, wordvec

    docs = spark.createDataFrame([(1, "red fox ran. fox ran fox!"), (2, None), (3, "..."), (4, "unknown. red"), (1, "fox sat. red. so")],
                                 "doc_id long, text string")
    table = spark.createDataFrame([("red", [1.0, 2.0]), ("fox", [0.5, -1.0]), ("fox", [0.5, -1.0]), ("ran", [3.0, 0.0]), ("sat", None)],
                                  "word string, vec array<double>")
    weights = spark.createDataFrame([("red", 0.5), ("fox", 0.25)], "word string, weight double")
    tok = vocab.sentence_tokens(docs.select("doc_id", T.sentences("text").alias("s")), "s", T.preprocess)
    want = {(r["doc_id"], r["sent_no"]): (r["n_words"], *r["vec"]) for r in wordvec.sentence_vectors(tok, table, weights, 2).collect()}
    for limit in (1 << 17, 2):
        monkeypatch.setattr(wordvec, "BLOCK_WORDS", limit)
        sents = wordvec.sentence_words(docs, T.sentences("text"), T.preprocess).withColumn("more", F.lit("x"))
        got = wordvec.on_sentences(sents, table, weights, 2).collect()
        found = {(r["doc_id"], r["sent_no"]): (r["n_words"], *r["vec"]) for r in got}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
        assert len(got) == len(want) and all(r["more"] == "x" for r in got)
    assert {r["sent_no"] for r in wordvec.sentence_words(docs, T.sentences("text"), T.preprocess, 1).collect()} == {0}


def test_attention_pools_words_in_blocks(spark, monkeypatch):
    from docvec.operators import attention as A
    from docvec.operators.wordvec import lookup

    tok = spark.createDataFrame([(1, "red"), (1, "fox"), (1, "red"), (2, "none"), (3, "none"), (3, "fox"), (4, "red")], "doc_id long, word string")
    wv = spark.createDataFrame([("red", [1.0, 2.0]), ("fox", [0.5, -1.0]), ("fox", [0.7, -1.0]), ("ran", [3.0, 0.0]), ("none", None)],
                               "word string, vec array<double>")
    counts = tok.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    W, b, u = np.array([[0.5, 0.1], [0.0, 0.5]]), np.array([0.05, -0.3]), np.array([1.0, -0.7])
    want = {r["doc_id"]: r["vec"] for r in A.attention_pool(lookup(tok, wv, 2), ["doc_id"], W, b, u, 1e-7).collect()}
    plain = {r["doc_id"]: r["vec"] for r in A.attention_pool_identity(lookup(tok, wv, 2), ["doc_id"], 2, 1e-7).collect()}
    for limit in (1 << 17, 2):
        monkeypatch.setattr(A, "BLOCK_WORDS", limit)
        got = {r["doc_id"]: r["vec"] for r in A.word_attention_pool(counts, wv, ["doc_id"], W, b, u, 1e-7).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        scored = wv.withColumn("s", A.identity_score("vec", 2))   # no score for the word without a vector
        got = {r["doc_id"]: r["vec"] for r in A.bag_attention_pool(counts, scored, ["doc_id"], 1e-7).collect()}
        assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k]) for k in plain)
    assert A.word_attention_pool(counts, wv.limit(0), ["doc_id"], W, b, u).where("vec is null").count() == 4


def test_documents_without_words_can_be_left_out(spark):
    from docvec.operators import wordvec

    docs = spark.createDataFrame([(1, ["red", "fox"], [2]), (2, [], []), (3, ["none"], [1]), (4, None, None)],
                                 "doc_id long, words array<string>, lens array<int>")
    table = spark.createDataFrame([("red", [1.0, 2.0], 1.0)], "word string, vec array<double>, weight double")
    mean = lambda rows, lens: wordvec.sentence_means(rows, lens).mean(axis=0)
    got = {r["doc_id"]: r["vec"] for r in wordvec.on_documents(docs, table, 2, mean, empty=False).collect()}
    assert got == {1: [0.5, 1.0], 3: [0.0, 0.0]}
    assert wordvec.on_documents(docs, table, 2, mean).count() == 4


def test_partitioned_vectors_work_in_blocks(spark, monkeypatch):
    import numpy as np

    from docvec.operators import psif

    monkeypatch.setattr(psif, "BLOCK_WORDS", 5)
    rng = np.random.default_rng(3)
    stats = [(w, rng.standard_normal(3).tolist(), rng.standard_normal(2).tolist(), 1.5, 0.25) for w in "aabcd"]   # a twice
    stats.append(("x", None, [1.0, 2.0], 1.0, 1.0))   # a null embedding: an error before
    counts = [(doc, w, n) for doc in (1, 2, 3, None) for n, w in enumerate("abcdx", 1) if doc != 2 or w == "x"]
    ws = spark.createDataFrame(stats, "word string, vec array<double>, coefs array<double>, idf double, weight double")
    c = spark.createDataFrame(counts, "doc_id long, word string, n long")
    made = psif.partitioned_doc_vectors(c, ws)
    assert "keys" in made._jdf.queryExecution().optimizedPlan().toString()   # a row per document and word before
    want = sum(n * 1.5 * 0.25 * np.outer(k, v) for _, w, n in counts[:5] for s, v, k, _, _ in stats if s == w and v).ravel()
    got = {r["doc_id"]: r["vec"] for r in made.collect()}
    assert set(got) == {1, 3, None}
    for v in got.values():
        np.testing.assert_allclose(v, want / np.linalg.norm(want), atol=1e-12)

"""End-to-end: registered queries run, embedders produce vectors, sense
tests of the classifier, sources and artifacts round-trip."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.columns == ["lang", "rank", "term", "score"]
    assert out.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 40


def test_bow_svm_separates_languages(spark, sf):
    from docvec.operators.svm import LinearSVM
    from docvec.operators.embedders import BOW
    from docvec.sources.corpus import from_table
    c = from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", "lang")
    m = BOW().fit(c)
    x = m.transform(c).join(c.select("doc_id", "target"), "doc_id")
    pred = LinearSVM(max_iter=25).fit(x, "features", "target").predict(x, "features")
    acc = pred.agg(F.avg((F.col("pred") == F.col("target")).cast("double"))).first()[0]
    assert acc > 0.9


def test_sif_and_psif_vectors(spark, sf):
    from docvec.operators.embedders import PSIF, SIF
    from docvec.operators.wordvec import derived_word_vectors
    from docvec.functions.text import preprocess
    from docvec.sources.corpus import from_table
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = from_table(docs, "doc_id", "text", "lang")
    words = docs.select(F.explode(preprocess("text")).alias("word"))
    wv = derived_word_vectors(words, spark.read.parquet(f"{sf}/embeddings.parquet"))
    for mode in ("projection", "elementwise", "corpus", "none"):
        v = SIF(wv, 64, pc_mode=mode).fit(c).doc_vectors(c)
        assert v.count() == c.count()
    p = PSIF(wv, 64, n_clusters=8, max_iter=3, out_dim=16).fit(c).doc_vectors(c).toPandas()
    assert len(p) == c.count() and len(p["vec"][0]) == 16


def test_doc2vec_deterministic(spark, sf):
    from docvec.operators.doc2vec import Doc2Vec
    from docvec.sources.corpus import from_table
    c = from_table(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text", None).withColumn("target", F.lit(0))
    m = Doc2Vec(size=16, epochs=2, dm=False).fit(c)
    a = m.doc_vectors(c).orderBy("doc_id").toPandas()
    b = m.doc_vectors(c).orderBy("doc_id").toPandas()
    assert np.allclose(np.stack(a["vec"]), np.stack(b["vec"]))


def test_csv_and_folder_sources(spark):
    from docvec.sources.corpus import read_csv_corpus, read_folder_corpus, read_split_folder_corpus
    d = tempfile.mkdtemp(prefix="docvec-src-")
    with open(os.path.join(d, "test.csv"), "w") as f:
        f.write('2,"a","b",\n')
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write('1,,"x ""q"" y","z"\n')
    rows = read_csv_corpus(spark, d).orderBy("doc_id").collect()
    assert [(r["text"], r["target"]) for r in rows] == [("ab", 1), ('x "q" yz', 0)]
    root = tempfile.mkdtemp(prefix="docvec-fold-")
    for split in ("training", "test"):
        for cls in ("sport", "arts"):
            os.makedirs(os.path.join(root, split, cls))
            with open(os.path.join(root, split, cls, "1.txt"), "wb") as f:
                f.write(f"{cls} \xe9caf".encode("latin-1") + "é".encode())  # a Latin-1 byte, then UTF-8
    s = read_split_folder_corpus(spark, root).collect()
    assert {(r["class_name"], r["target"]) for r in s} == {("arts", 0), ("sport", 1)}
    assert all(r["text"] == f"{r['class_name']} caf" for r in s)     # us-ascii: other bytes left out
    u = read_folder_corpus(spark, os.path.join(root, "training"), "utf-8").collect()
    assert all(r["text"] == f"{r['class_name']} café" for r in u)    # utf-8: what is not UTF-8 is left out


def test_word_vector_file(spark):
    from docvec.sources.vectors import read_word_vectors
    d = tempfile.mkdtemp(prefix="docvec-wv-")
    p = os.path.join(d, "vec.txt")
    with open(p, "w") as f:
        f.write("a 1 2 3\nb 4 5\nc 7 8 9\na 0 0 1\n")
    rep = {}
    wv = {r["word"]: r["vec"] for r in read_word_vectors(spark, p, 3, rep).collect()}
    assert rep["rejected"] == 1 and wv["a"] == [0.0, 0.0, 1.0] and set(wv) == {"a", "c"}


def test_artifact_round_trip(spark):
    from docvec.sources.artifacts import can_load, load_artifact, save_artifact
    d = os.path.join(tempfile.mkdtemp(prefix="docvec-art-"), "m")
    assert not can_load(spark, d)
    t = spark.createDataFrame([("a", 1)], "term string, id long")
    save_artifact(spark, d, {"max_df": 0.95}, {"vocab": t})
    params, tables, _ = load_artifact(spark, d)
    assert can_load(spark, d) and params == {"max_df": 0.95} and tables["vocab"].count() == 1


def test_embed_with_stub_model(spark, sf):
    from docvec.operators.transformer import embed_with

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    out = embed_with(spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"), load, 2)
    r = out.first()
    assert len(r["vec"]) == 2 and r["vec"][1] == 1.0

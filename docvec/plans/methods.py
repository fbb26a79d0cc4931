"""Rows-only registered queries: the iterative / learned methods that have no
SQL twin (checked against numpy and sense tests in ``tests/``).  Each reads
the whole given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from docvec.operators import wordvec
from docvec.session import load, written


def _corpus(spark, sf):
    from docvec.sources.corpus import from_table
    return from_table(load(spark, sf, "documents"), "doc_id", "text", "lang")


def _wv(spark, sf):
    from docvec.functions.text import preprocess
    # explode would filter on the tokens first, and so make them twice
    words = load(spark, sf, "documents").select(F.posexplode_outer(preprocess("text")).alias("_pos", "word")).where("_pos is not null")
    return wordvec.derived_word_vectors(words, load(spark, sf, "embeddings"))


def _dim(spark, sf):
    return int(load(spark, sf, "embeddings").select(F.size("embedding")).first()[0])


def _long(df):
    return wordvec.long_vectors(df.select("doc_id", vector_to_array("features").alias("vec")), ["doc_id"])


def m_sif_doc_vectors(spark, sf):
    """E3-E5 with per-document principal-direction removal."""
    from docvec.operators.embedders import SIF
    c = _corpus(spark, sf)
    return _long(SIF(_wv(spark, sf), _dim(spark, sf)).fit(c).transform(c))


def m_psif(spark, sf):
    """K-SVD dictionary, OMP codes, partitioned vectors, PCA."""
    from docvec.operators.embedders import PSIF
    c = _corpus(spark, sf)
    return _long(PSIF(_wv(spark, sf), _dim(spark, sf), n_clusters=40).fit(c).transform(c))


def m_ksvd_clusters(spark, sf):
    """E7/E8 on the embeddings table: dictionary of 40 atoms, hard cluster
    of every row."""
    from docvec.operators.linalg import ApproxKSVD
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    k = ApproxKSVD(40, 10, n_nonzero=20).fit(e, "vec")
    c = k.transform(e, "vec", "coefs")
    return c.select("vec_id", (F.array_position("coefs", F.array_max("coefs")) - 1).alias("cluster"))


def m_pca(spark, sf):
    """Centred PCA of the embeddings to 16 components."""
    from docvec.operators.linalg import CenteredPCA
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    p = CenteredPCA(16).fit(e, "vec")
    return wordvec.long_vectors(p.transform(e, "vec", "vec").withColumnRenamed("vec_id", "doc_id"), ["doc_id"])


def m_lsa(spark, sf):
    """LSA, 100 components, 10 power iterations."""
    from docvec.operators.embedders import LSA
    c = _corpus(spark, sf)
    return _long(LSA(k=100, n_iter=10).fit(c).transform(c))


def m_lda(spark, sf):
    """LDA, 100 topics, 10 iterations."""
    from docvec.operators.embedders import LDA
    c = _corpus(spark, sf)
    return _long(LDA(k=100, max_iter=10).fit(c).transform(c))


METHOD_QUERIES = {
    "m_sif_doc_vectors": m_sif_doc_vectors,
    "m_psif": m_psif,
    "m_ksvd_clusters": m_ksvd_clusters,
    "m_pca": m_pca,
    "m_lsa": m_lsa,
    "m_lda": m_lda,
}


def m_han(spark, sf):
    """Hierarchical attention encoder, early stop, patience 5."""
    from docvec.operators.han import HierarchicalAttention
    c = _corpus(spark, sf)
    return _long(HierarchicalAttention(written(_wv(spark, sf)), _dim(spark, sf)).fit(c).transform(c))


def m_transformer(spark, sf):
    """First-token vectors of a caller's model (here: letter shares of the
    cleaned text)."""
    import numpy as np
    from docvec.plans.runner import build_methods

    def load_model():
        def encode(texts):
            counts = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)
            return counts / np.maximum(counts.sum(1, keepdims=True), 1.0)
        return encode

    c = _corpus(spark, sf)
    return _long(build_methods(load_fn=load_model, load_dim=26)["transformer"]().fit(c).transform(c))


def m_han_features(spark, sf):
    """HAN with tf-idf token features merged by 'add', min_delta 0.001."""
    from docvec.operators.han import HierarchicalAttention
    c = _corpus(spark, sf)
    m = HierarchicalAttention(written(_wv(spark, sf)), _dim(spark, sf), features="tfidf", operation="add", min_delta=0.001)
    return _long(m.fit(c).transform(c))


METHOD_QUERIES.update({
    "m_transformer": m_transformer,
    "m_han": m_han,
    "m_han_features": m_han_features,
})

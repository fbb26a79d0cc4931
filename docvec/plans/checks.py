"""Query and oracle pairs for the options of finished operators and for what
plain SQL can say about the learned ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.functions import text as T
from docvec.operators import classify, splits, vocab, wordvec
from docvec.operators.blocks import array_of, row_of
from docvec.plans import queries as Q
from docvec.plans import sqltext as S
from docvec.session import dropped, load, written

ATOMS = 8          # the dictionary of the coding checks: the first vectors of the table
LDA_TOPICS = 100
STEP_TOPICS = 4
TEST_SHARE = 0.2   # of the rows, in the repeated hold-out runs


# ---------------------------------------------------------------- text and grids
def t16_dot_sentences(spark, sf):
    d = Q._docs(spark, sf).select("doc_id", F.posexplode(T.dot_sentences("text")).alias("no", "sentence"))
    return d.select("doc_id", F.col("no").cast("long").alias("sent_no"), "sentence")


def v8_nested_grid(spark, sf):
    """The padded grid, checked by a sum that weighs each cell by its place."""
    docs = Q._grid_docs(spark, sf)
    g = vocab.id_grid(docs, Q._grid_ids(docs), Q.MAX_SENTS, Q.MAX_WORDS)
    cells = g.select("doc_id", F.flatten("grid").alias("c"))
    weighed = F.aggregate(F.transform("c", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return cells.select("doc_id", F.size("c").cast("long").alias("n_cells"), weighed.alias("weighed"))


def _features(spark, sf, norm: str | None) -> DataFrame:
    """Token features of the kept grid tokens: counts, or counts over their
    length (norm l2)."""
    docs = Q._grid_docs(spark, sf)
    words = vocab.tokens_of(docs).select(F.explode("tokens").alias("term")).distinct().withColumn("idf", F.lit(1.0))
    return Q._features(docs, words, norm)


def v9_features_bow(spark, sf):
    return _features(spark, sf, None)


def v9_features_tf(spark, sf):
    return _features(spark, sf, "l2")


# ---------------------------------------------------------------- vectors
def e5_uniform(spark, sf):
    """SIF with every weight 1 and no direction removed, by the fitted method."""
    from docvec.operators.embedders import SIF
    from docvec.plans.methods import _corpus
    words = Q._tokens(spark, sf).select(F.explode("tokens").alias("word"))
    wv, c = Q._wv_for(words, spark, sf), _corpus(spark, sf)
    m = SIF(wv, Q._dim(spark, sf), weighting="uniform", pc_mode="none").fit(c)
    return wordvec.long_vectors(m.doc_vectors(c), ["doc_id"]).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), "value")


def _vectors(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _coded(spark, sf, n_nonzero: int) -> DataFrame:
    """OMP codes of all vectors over the dictionary of the first ATOMS ones."""
    from docvec.operators.linalg import ApproxKSVD
    e = _vectors(spark, sf)
    first = e.where(F.col("vec_id") < ATOMS).orderBy("vec_id").collect()  # ATOMS rows
    k = ApproxKSVD(ATOMS, n_nonzero=n_nonzero)
    k.components_ = np.array([r["vec"] for r in first])
    return k.transform(e.where(F.col("vec_id") >= ATOMS), "vec", "coefs").select(
        "vec_id", F.posexplode("coefs").alias("atom", "coef")).where("coef <> 0").select(
        "vec_id", F.col("atom").cast("long").alias("atom"), F.round("coef", 6).alias("coef"))


def e6_omp_one(spark, sf):
    return _coded(spark, sf, 1)


def e6_omp_two(spark, sf):
    return _coded(spark, sf, 2)


def e11_centred_norms(spark, sf):
    """Centred PCA that keeps every component keeps every length."""
    from docvec.operators.linalg import CenteredPCA
    e = _vectors(spark, sf)
    y = CenteredPCA(Q._dim(spark, sf)).fit(e, "vec").transform(e, "vec", "y")
    return y.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sq_norm"))


def e11_plane_components(spark, sf):
    """Components and variances of the vectors' first two entries: a 2 x 2
    case that has a closed form."""
    from docvec.operators.linalg import CenteredPCA
    e = _vectors(spark, sf).select(F.slice("vec", 1, 2).alias("vec"))
    p = CenteredPCA(2).fit(e, "vec")
    v, w = p.components(), p.eigenvalues_
    return spark.createDataFrame([(j + 1, float(v[0, j]), float(v[1, j]), float(w[j])) for j in range(2)],
                                 "component int, x double, y double, variance double").select(
        "component", *[F.round(c, 6).alias(c) for c in ("x", "y", "variance")])


def e13_topic_mixtures(spark, sf):
    """Topics per document, and their sum."""
    from docvec.operators.embedders import LDA
    from docvec.plans.methods import _corpus
    c = _corpus(spark, sf)
    t = LDA(k=LDA_TOPICS, max_iter=10).fit(c).transform(c).select("doc_id", vector_to_array("features").alias("v"))
    return t.select("doc_id", F.size("v").cast("long").alias("n_topics"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("mix"))


def e13_lda_step(spark, sf):
    """Topic shares after one full step of batch LDA from given topic weights,
    one pass over the documents' mixtures each time."""
    from docvec.operators.embedders import LDA
    from docvec.plans.methods import _corpus
    c = _corpus(spark, sf)
    part = lambda t: F.conv(F.substring(F.md5(F.concat("term", F.lit(f"-{t}"))), 1, 4), 16, 10).cast("double")
    terms = Q._tokens(spark, sf).select(F.explode("tokens").alias("term")).distinct()
    start = terms.select("term", F.array(*[0.5 + part(t) / 65536.0 for t in range(STEP_TOPICS)]).alias("w"))
    m = LDA(k=STEP_TOPICS, max_iter=1, max_doc_iter=1, start=start.select("term", row_of("w").alias("row"))).fit(c)
    t = m.transform(c).select("doc_id", F.posexplode(vector_to_array("features")).alias("topic", "share"))
    return t.select("doc_id", F.col("topic").cast("long").alias("topic"), F.round("share", 6).alias("share"))


def _psi(x: str) -> str:
    """Digamma in SQL: recurrence over eight steps, then the asymptotic series."""
    y = f"(({x}) + 8.0)"
    series = "".join(f" {sign} 1.0 / ({d} * {y} ** {p})" for sign, d, p in (("-", 12, 2), ("+", 120, 4), ("-", 252, 6), ("+", 240, 8), ("-", 132, 10)))
    return f"(ln{y} - 0.5 / {y}{series}" + "".join(f" - 1.0 / (({x}) + {j}.0)" for j in range(8)) + ")"


def e17_attention_w(spark, sf):
    """Pooling with a projection that mixes neighbouring coordinates."""
    from docvec.operators.attention import word_attention_pool
    d = Q._dim(spark, sf)
    W = 0.5 * np.eye(d) + 0.1 * np.eye(d, k=1)
    u = np.where(np.arange(d) % 2 == 0, 1.0, -1.0) / np.sqrt(d)
    bags = Q._bags(spark, sf)
    wv = Q._wv_for(written(vocab.words_of(bags)), spark, sf)
    pooled = word_attention_pool(bags, wv, ["doc_id"], W, np.full(d, 0.05), u, Q.EPS, d)
    dropped(bags)
    pooled = pooled.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), d)))  # no word is known
    return wordvec.long_vectors(pooled, ["doc_id"]).select("doc_id", F.col("dim").cast("long").alias("dim"), "value")


# ---------------------------------------------------------------- classification
def c1_quality_weight(spark, sf):
    y = load(spark, sf, "labels")
    return classify.class_weights(y, "quality").select(
        F.col("quality").cast("long").alias("quality"), F.col("n").cast("long").alias("n"), F.round("weight", 9).alias("weight"))


def x11_balance_labels(spark, sf):
    """Both ways of balancing, counted per class."""
    y = load(spark, sf, "labels").select("doc_id", "quality")
    down, up = splits.balance(y, "quality", Q.SEED, "doc_id"), splits.balance(y, "quality", Q.SEED, "doc_id", upsampling=True)
    count = lambda df, way: df.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).withColumn("way", F.lit(way))
    return count(down, "down").unionByName(count(up, "up")).select("way", F.col("quality").cast("long").alias("quality"), "n", "docs")


def _beats(runs: DataFrame, parts: DataFrame, out: str) -> DataFrame:
    """Runs beside the size of their test part and its largest class's share."""
    per = parts.groupBy("run", "target").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(
        F.sum("n").alias("n_test"), F.max("n").alias("most"))
    j = per.join(runs.select(F.col("run").cast("long").alias("run"), "accuracy"), "run")
    share = F.col("most") / F.col("n_test")
    return j.select("run", F.col("n_test").cast("long").alias("n_test"), F.round(share, 9).alias("majority"),
                    (F.col("accuracy") > share).alias(out))


def m_bow_svm_cv(spark, sf):
    """X2 + C2: 5-fold cross-validation of BOW + linear SVM on the language."""
    from docvec.plans.methods import _corpus
    from docvec.plans.runner import build_methods, cross_validate
    c = _corpus(spark, sf)
    runs, _, _ = cross_validate(spark, c, {"bow": build_methods()["bow"]}, k=Q.FOLDS)
    folds = splits.kfold(c.select("doc_id", "target"), Q.FOLDS, "doc_id")
    return _beats(runs, folds.withColumn("run", F.col("fold").cast("long")), "svm_beats_majority")


def c2_svm_weights(spark, sf):
    """C2 on rows whose only feature names their class: every margin is met and
    the weights have a closed form."""
    from docvec.operators.svm import BIAS, LinearSVM
    y = splits.label_index(load(spark, sf, "documents").select("doc_id", "lang"), "lang")
    one = F.struct(F.array(F.col("target").cast("long")).alias("i"), F.array(F.lit(1.0)).alias("v"))
    m = LinearSVM(tol=1e-9).fit(y.select("doc_id", one.alias("vec"), "target"))
    w = m.weights.select(F.col("key").alias("feature"), F.posexplode(array_of("row")).alias("class", "weight"))
    return w.select(F.col("class").cast("long").alias("class"), "feature", (F.col("feature") == BIAS).alias("is_bias"), F.round("weight", 3).alias("weight"))


def m_tfidf_knn_tt(spark, sf):
    """X3 + C3: five repeats of TF-IDF + nearest neighbours on a hold-out."""
    from docvec.plans.methods import _corpus
    from docvec.plans.runner import build_methods, train_test
    c = splits.holdout(_corpus(spark, sf), TEST_SHARE, Q.SEED, "doc_id")
    c = c.withColumn("split", F.when(F.col("split") == "val", "test").otherwise("train"))
    runs, _, _ = train_test(spark, c, {"tfidf": build_methods()["tfidf"]}, repeats=5, classifier="knn")
    test = c.where("split = 'test'").select("target", F.explode(F.expr("sequence(1L, 5L)")).alias("run"))
    return _beats(runs, test, "knn_beats_majority")


def _doc2vec(spark, sf, dm: bool) -> DataFrame:
    """40 epochs, tag = language; one vector of 100 per document."""
    from docvec.operators.doc2vec import Doc2Vec
    from docvec.plans.methods import _corpus
    c = _corpus(spark, sf)
    v = Doc2Vec(size=100, window=5, negative=10, epochs=40, dm=dm).fit(c).doc_vectors(c)
    finite = F.forall("vec", lambda x: F.abs(x) < float("inf"))
    return v.select("doc_id", F.size("vec").cast("long").alias("n_dims"), finite.alias("finite"))


def e15_dbow_step(spark, sf):
    """E15 after one epoch of one step per document without negatives, a tag
    for each document: the output vector of a word that only one document has
    moved by half the rate times its count along that document's tag."""
    from docvec.operators.doc2vec import Doc2Vec
    c = Q._docs(spark, sf).select("doc_id", "text")
    part = lambda j: F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-{j}"))), 1, 4), 16, 10).cast("double")
    start = c.select(F.col("doc_id").alias("tag"), F.array(*[part(j) / 65536.0 - 0.5 for j in range(2)]).alias("vec"))
    m = Doc2Vec(size=2, negative=0, epochs=1, dm=False, tag_col="doc_id", step=1 << 30, block_words=1 << 20, max_step_norm=None, start=start).fit(c)
    df = Q._tokens(spark, sf).select("doc_id", F.explode("tokens").alias("word")).groupBy("word").agg(F.countDistinct("doc_id").alias("df"))
    v = m.params.join(m.vocab, m.params["key"] == m.vocab["id"]).join(df.where("df = 1"), "word").select("word", "cf", array_of("row").alias("v"))
    return v.select("word", F.col("cf").cast("long").alias("cf"), F.round(F.col("v")[2], 9).alias("out0"), F.round(F.col("v")[3], 9).alias("out1"))


def m_doc2vec_dm(spark, sf):
    return _doc2vec(spark, sf, True)


def m_doc2vec_dbow(spark, sf):
    return _doc2vec(spark, sf, False)


_FEATURES = f"""g AS {Q._GRID}, kc AS (SELECT doc_id, word, count(*) AS n FROM g GROUP BY 1, 2),
    kn AS (SELECT doc_id, sqrt(sum(n * n)) AS nrm FROM kc GROUP BY doc_id)"""
_CODES = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT vec_id AS atom, x AS d FROM e WHERE vec_id < {ATOMS}),
    c AS (SELECT e.vec_id, d.atom, d.d, list_inner_product(e.x, d.d) AS p FROM e, d WHERE e.vec_id >= {ATOMS}),
    one AS (SELECT vec_id, atom, d, p FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(p) DESC, atom) = 1)"""
_SHARE = "round(max(n) / sum(n), 9) AS majority"
_CLASS = "(SELECT doc_id, lang AS target FROM documents)"

SQL: dict[str, str] = {
    "t16_dot_sentences": """SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_no, unnest(s) AS sentence
        FROM (SELECT doc_id, string_split(coalesce(text, ''), '.') AS s FROM documents)""",
    "v8_nested_grid": f"""SELECT doc_id, {Q.MAX_SENTS * Q.MAX_WORDS}::BIGINT AS n_cells,
        sum(id * (sent_no * {Q.MAX_WORDS} + pos + 1))::BIGINT AS weighed FROM {Q._GRID} GROUP BY doc_id""",
    "v9_features_bow": f"""WITH {_FEATURES} SELECT doc_id, sent_no::BIGINT AS sent_no, pos::BIGINT AS pos, round(n::DOUBLE, 6) AS value
        FROM g JOIN kc USING (doc_id, word)""",
    "v9_features_tf": f"""WITH {_FEATURES} SELECT doc_id, sent_no::BIGINT AS sent_no, pos::BIGINT AS pos, round(n / nrm, 6) AS value
        FROM g JOIN kc USING (doc_id, word) JOIN kn USING (doc_id)""",
    "e5_uniform": f"""WITH st AS {Q._SENT_TOK}, wv AS {Q._WV},
        lens AS (SELECT doc_id, sent_no, count(*) AS n_words FROM st GROUP BY 1, 2),
        el AS (SELECT st.doc_id, st.sent_no, unnest(wv.vec) AS x, generate_subscripts(wv.vec, 1) - 1 AS dim FROM st JOIN wv USING (word)),
        sums AS (SELECT doc_id, sent_no, dim, sum(x) AS s FROM el GROUP BY 1, 2, 3),
        dims AS (SELECT range AS dim FROM range(0, (SELECT len(embedding) FROM embeddings LIMIT 1))),
        sv AS (SELECT l.doc_id, dims.dim, coalesce(s.s, 0.0) / greatest(l.n_words, 2) AS v
               FROM lens l CROSS JOIN dims LEFT JOIN sums s ON s.doc_id = l.doc_id AND s.sent_no = l.sent_no AND s.dim = dims.dim),
        m AS (SELECT doc_id, dim, avg(v) AS v FROM sv GROUP BY doc_id, dim)
        SELECT d.doc_id, dims.dim::BIGINT AS dim, round(coalesce(m.v, 0.0), 6) AS value
        FROM documents d CROSS JOIN dims LEFT JOIN m ON m.doc_id = d.doc_id AND m.dim = dims.dim""",
    "e6_omp_one": f"WITH {_CODES} SELECT vec_id, atom, round(p / list_inner_product(d, d), 6) AS coef FROM one WHERE p <> 0",
    "e6_omp_two": f"""WITH {_CODES},
        two AS (SELECT c.vec_id, one.atom AS a, c.atom AS b, one.p AS pa, c.p AS pb, list_inner_product(one.d, c.d) AS g,
                       list_inner_product(one.d, one.d) AS ga, list_inner_product(c.d, c.d) AS gb
                FROM c JOIN one USING (vec_id) WHERE c.atom <> one.atom
                QUALIFY row_number() OVER (PARTITION BY c.vec_id ORDER BY abs(c.p - one.p / list_inner_product(one.d, one.d)
                  * list_inner_product(one.d, c.d)) DESC, c.atom) = 1),
        s AS (SELECT vec_id, a, b, (gb * pa - g * pb) / (ga * gb - g * g) AS ca, (ga * pb - g * pa) / (ga * gb - g * g) AS cb FROM two)
        SELECT vec_id, a AS atom, round(ca, 6) AS coef FROM s UNION ALL SELECT vec_id, b, round(cb, 6) FROM s""",
    "e11_centred_norms": """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT i, avg(x) AS m FROM e GROUP BY i)
        SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS sq_norm FROM e JOIN m USING (i) GROUP BY vec_id""",
    "e11_plane_components": """WITH e AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
        c AS (SELECT var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM e),
        w AS (SELECT k AS component, b, a, (a + c) / 2 + (3 - 2 * k) * sqrt((a - c) * (a - c) / 4 + b * b) AS variance
              FROM c, (SELECT unnest([1, 2]) AS k)),
        u AS (SELECT component, variance, b / sqrt(b * b + (variance - a) ** 2) AS x, (variance - a) / sqrt(b * b + (variance - a) ** 2) AS y FROM w),
        s AS (SELECT *, CASE WHEN (CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS flip FROM u)
        SELECT component::INT AS component, round(flip * x, 6) AS x, round(flip * y, 6) AS y, round(variance, 6) AS variance FROM s""",
    "e13_topic_mixtures": f"""WITH {Q._BOW_VOCAB.format(tok=Q._TOKSWV)}, k AS (SELECT DISTINCT doc_id FROM dtm JOIN voc USING (term))
        SELECT d.doc_id, {LDA_TOPICS}::BIGINT AS n_topics, 1.0::DOUBLE AS mix FROM documents d LEFT JOIN k USING (doc_id)""",
    "e13_lda_step": f"""WITH {Q._BOW_VOCAB.format(tok=Q._TOKSWV)}, t AS (SELECT range AS topic FROM range({STEP_TOPICS})),
        c AS MATERIALIZED (SELECT doc_id, term, n FROM dtm JOIN voc USING (term)),
        l0 AS MATERIALIZED (SELECT term, topic, 0.5 + ('0x' || substr(md5(term || '-' || topic), 1, 4))::INT / 65536.0::DOUBLE AS l
                            FROM (SELECT DISTINCT term FROM c), t),
        s0 AS (SELECT topic, {_psi("sum(l)")} AS s FROM l0 GROUP BY topic),
        b0 AS MATERIALIZED (SELECT term, topic, exp({_psi("l")} - s) AS b FROM l0 JOIN s0 USING (topic)),
        r0 AS (SELECT term, topic, b, b / sum(b) OVER (PARTITION BY term) AS r FROM b0),
        g0 AS (SELECT doc_id, topic, 1.0 / {STEP_TOPICS} + sum(n * r) AS g FROM c JOIN r0 USING (term) GROUP BY 1, 2),
        th AS (SELECT doc_id, topic, exp({_psi("g")} - {_psi("sum(g) OVER (PARTITION BY doc_id)")}) AS th FROM g0),
        e AS (SELECT c.doc_id, c.term, b0.topic, c.n, th.th * b0.b AS p, sum(th.th * b0.b) OVER (PARTITION BY c.doc_id, c.term) AS norm
              FROM c JOIN b0 USING (term) JOIN th ON th.doc_id = c.doc_id AND th.topic = b0.topic),
        l1 AS MATERIALIZED (SELECT term, topic, 1.0 / {STEP_TOPICS} + sum(n * p / norm) AS l FROM e GROUP BY 1, 2),
        s1 AS (SELECT topic, {_psi("sum(l)")} AS s FROM l1 GROUP BY topic),
        b1 AS (SELECT term, topic, exp({_psi("l")} - s) AS b FROM l1 JOIN s1 USING (topic)),
        r1 AS (SELECT term, topic, b / sum(b) OVER (PARTITION BY term) AS r FROM b1),
        g1 AS (SELECT doc_id, topic, sum(n * r) AS g FROM c JOIN r1 USING (term) GROUP BY 1, 2),
        a AS (SELECT d.doc_id, t.topic, 1.0 / {STEP_TOPICS} + coalesce(g, 0.0) AS g FROM documents d CROSS JOIN t
              LEFT JOIN g1 ON g1.doc_id = d.doc_id AND g1.topic = t.topic)
        SELECT doc_id, topic::BIGINT AS topic, round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS share FROM a""",
    "e17_attention_w": f"""WITH wv AS {Q._WV},
        d AS (SELECT len(embedding) AS d FROM embeddings LIMIT 1),
        t AS (SELECT tk.doc_id, coalesce(wv.vec, list_transform(range(0, d.d), lambda i: 0.0::DOUBLE)) AS vec
              FROM {Q._TOKV} tk LEFT JOIN wv USING (word), d),
        a AS (SELECT doc_id, vec, exp(list_sum(list_transform(vec, lambda x, i:
                tanh(0.5 * x + 0.1 * (CASE WHEN i > 1 THEN vec[i - 1] ELSE 0.0 END) + 0.05) * (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END)))
                / sqrt(d.d)) AS a FROM t, d),
        den AS (SELECT doc_id, sum(a) AS sa FROM a GROUP BY doc_id),
        el AS (SELECT doc_id, a, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS dim FROM a)
        SELECT el.doc_id, dim::BIGINT AS dim, round(sum(a * x) / (max(den.sa) + {Q.EPS}), 6) AS value
        FROM el JOIN den USING (doc_id) GROUP BY el.doc_id, dim""",
    "c1_quality_weight": """WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), t AS (SELECT sum(n) AS t, count(*) AS k FROM n)
        SELECT quality::BIGINT AS quality, n::BIGINT AS n, round(t / (k * n), 9) AS weight FROM n, t""",
    "x11_balance_labels": """WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
        b AS (SELECT min(n) AS least, max(n) AS most FROM n)
        SELECT 'down' AS way, quality::BIGINT AS quality, least::BIGINT AS n, least::BIGINT AS docs FROM n, b
        UNION ALL SELECT 'up', quality::BIGINT, most::BIGINT, n::BIGINT FROM n, b""",
    "m_bow_svm_cv": f"""WITH f AS (SELECT target, ntile({Q.FOLDS}) OVER (ORDER BY doc_id) AS run FROM {_CLASS}),
        c AS (SELECT run, target, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT run::BIGINT AS run, sum(n)::BIGINT AS n_test, {_SHARE}, true AS svm_beats_majority FROM c GROUP BY run""",
    "c2_svm_weights": """WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents),
        b AS (SELECT k, (2.0 - k) / (k + 1.0) AS b FROM k),
        f AS (SELECT b.k, b.b, c.range AS class, g.range - 1 AS feature FROM b, range(0, (SELECT k FROM k)) c, range(0, (SELECT k + 1 FROM k)) g)
        SELECT class::BIGINT AS class, feature::BIGINT AS feature, feature = -1 AS is_bias,
          round(CASE WHEN feature = -1 THEN b WHEN feature = class THEN 1.0 - b ELSE -1.0 - b END, 3)::DOUBLE AS weight FROM f""",
    "m_tfidf_knn_tt": f"""WITH r AS (SELECT lang, row_number() OVER (ORDER BY {Q._SHUF}, doc_id) AS pos, count(*) OVER () AS n FROM documents),
        c AS (SELECT lang, count(*) AS n FROM r WHERE pos > n - floor({TEST_SHARE} * n) GROUP BY lang)
        SELECT range::BIGINT AS run, sum(n)::BIGINT AS n_test, {_SHARE}, true AS knn_beats_majority FROM c, range(1, 6) GROUP BY range""",
    "e15_dbow_step": f"""WITH w AS (SELECT word, min(doc_id) AS doc_id, count(*) AS cf FROM {Q._TOKV} GROUP BY word HAVING count(DISTINCT doc_id) = 1)
        SELECT word, cf::BIGINT AS cf, round(0.0125::DOUBLE * cf * (('0x' || substr(md5(doc_id || '-0'), 1, 4))::INT / 65536.0::DOUBLE - 0.5), 9) AS out0,
          round(0.0125::DOUBLE * cf * (('0x' || substr(md5(doc_id || '-1'), 1, 4))::INT / 65536.0::DOUBLE - 0.5), 9) AS out1 FROM w""",
    "m_doc2vec_dm": "SELECT doc_id, 100::BIGINT AS n_dims, true AS finite FROM documents",
    "m_doc2vec_dbow": "SELECT doc_id, 100::BIGINT AS n_dims, true AS finite FROM documents",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in SQL}

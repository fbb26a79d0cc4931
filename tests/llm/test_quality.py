import numpy as np

from docvec.llm import quality


def auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return (a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean()


def test_tables_and_pairs_learn_what_they_should():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells
    model = quality.boost(x[:3000], y[:3000])
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert auc(model.score(x[3000:]), y[3000:]) > 0.95
    y = (x[:, 2] ** 2 > 0.5).astype(float)  # a table need not be monotone
    assert auc(quality.boost(x[:3000], y[:3000]).score(x[3000:]), y[3000:]) > 0.97


def test_no_labels_or_one_class():
    assert quality.boost(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.boost(np.zeros((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.99).all()
    assert (quality.boost(np.zeros((6, 2)), np.array([0, 1.0] * 3)).score(np.zeros((2, 2))) == 0.5).all()


def test_features_of_long_texts_do_not_depend_on_parts(monkeypatch):
    text = ("one two two. THREE 4 | !\n" * 50).encode()
    whole = quality.text_features(text)
    assert len(whole) == len(quality.FEATURES) == len(quality.text_features(b""))
    monkeypatch.setattr(quality, "PART_BYTES", 100)
    parts = quality.text_features(text)
    assert all(a == b for n, a, b in zip(quality.FEATURES, whole, parts) if n not in ("distinct", "top_word", "repeats"))


def test_query_on_held_out_documents(spark):
    from docvec.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op10_quality"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    tested = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert auc(np.array([r["score"] for r in tested]), np.array([labels[r["doc_id"]] for r in tested])) > 0.97


def test_rows_of_all_kinds(spark):
    rows = [(i, "good text " * (i % 7) if i % 3 else "BAD!! " * 9, "a") for i in range(60)]
    rows += [(None, "x", "b"), (70, None, "c"), (71, "", "d"), (3, "again", "e"), (72, "w " * 1_000_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(3, 1), (None, 1), (70, None)],
                                   "doc_id long, quality int")
    x = quality.featured(docs)
    got = quality.score(x, quality.fit(x, labels, "true")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = x.where("false")
    assert quality.score(none, quality.fit(none, labels, "true")).count() == 0
    assert {r["score"] for r in quality.score(x, quality.fit(x, labels.where("false"), "true")).collect()} == {0.5}


def test_features_do_not_depend_on_the_parts(monkeypatch):
    text = ("one one two three\n" * 40 + "two two " * 30 + "four").encode()
    whole = quality.text_features(text)
    monkeypatch.setattr(quality, "PART_BYTES", 11)
    assert quality.text_features(text) == whole

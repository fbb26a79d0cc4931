"""Blocks that get their parameter rows together, and rows that travel at half their size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docvec.operators import blocks as B
from docvec.operators import vocab, wordvec


def test_narrow_rows_keep_every_number(spark):
    rows = [[0.5, -2.0, 0.1], [0.1, 1.0, 0.3], [7.0], [float("nan"), 1.0, 2.0], [1e300, 0.0, 1.0], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<double>")
    got = {r["i"]: bytes(r["row"]) for r in df.select("i", B.narrow_row("a").alias("row")).collect()}
    assert [len(got[i]) for i in range(6)] == [16, 24, 8, 24, 24, 0]
    three = [i for i, r in enumerate(rows) if len(r) == 3]
    column = pa.chunked_array([pa.array([b"x"] + [got[i] for i in three], pa.binary()).slice(1), pa.array([got[0]], pa.binary())])
    np.testing.assert_array_equal(B.matrix(column, 3), np.array([rows[i] for i in three] + [rows[0]]))
    alike = pa.array([got[0], got[0]], pa.binary())
    np.testing.assert_array_equal(B.matrix(alike, 3), np.array([rows[0]] * 2))
    np.testing.assert_array_equal(B.matrix(pa.array([got[1]], pa.binary()), 3), np.array([rows[1]]))


@pytest.mark.parametrize("key", ["string", "bigint"])
def test_blocks_together_give_what_they_give_alone(spark, key):
    """Words that a block does not know, that the table has twice, and blocks without a word of the table."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" if key == "string" else i for i in range(40)]
    docs = [(i, [words[j] for j in rng.integers(0, 40, rng.integers(0, 9))]) for i in range(400)]
    table = [(w, [float(x) for x in rng.integers(-9, 9, 2)] + [0.1 * (j + 1)]) for j, w in enumerate(words[:30])] + [(words[3], [1.0, 2.0, 0.7])]
    df = spark.createDataFrame(docs, f"id long, words array<{key}>").repartition(3, "id")
    rows = spark.createDataFrame(table, f"key {key}, a array<double>").select("key", B.narrow_row("a").alias("row"))
    packed = B.packed(df, "words", 16)
    group = B.in_groups(packed, 4)
    n = spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in group.groupBy("group").count().collect()]
    assert max(sizes) <= 4 and len(sizes) >= n and sum(sizes) == packed.count() and max(sizes) > 1
    assert B.in_groups(packed.limit(1), 4) is None and B.in_groups(packed, 1) is None

    def run(block):
        offsets, place = block.lists("words")
        (params, times), found = block.summed(), block.matches(place.astype(np.int64))
        s = [[float(params[p].sum()) for p in place[a:e].astype(np.int64)] for a, e in zip(offsets[:-1], offsets[1:])]
        return pa.table({"id": block.table.column("id"), "s": pa.array(s, pa.list_(pa.float64())),
                         "known": pa.array([int(block.known.sum())] * len(s), pa.int64()), "n": pa.array([len(found[0])] * len(s), pa.int64()),
                         "twice": pa.array([int(times.max(initial=0))] * len(s), pa.int64())})

    decode = wordvec._times_weight
    got = [sorted(map(tuple, B.on_blocks(packed, rows, 3, run, "id long, s array<double>, known long, n long, twice long", t, decode).collect()))
           for t in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == 400
    want = {}
    for w, (x, y, z) in table:
        want[w] = want.get(w, 0.0) + (x * z + y * z)
    by_id = dict(docs)
    for i, s, *_ in got[1]:
        np.testing.assert_allclose(s, [want.get(w, 0.0) for w in by_id[i]])


def test_a_word_travels_once_to_blocks_that_work_together(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(400)], "id long, words array<string>").coalesce(1)
    packed = B.packed(docs, "words", 8)
    n, group = packed.count(), B.in_groups(packed, 8)
    # a row per group and word, where each block would ask for its own
    asked = group.select("group", F.explode("keys").alias("key")).distinct().count()
    assert n == 200 and asked == 3 * group.select("group").distinct().count() <= 3 * n / 5


def test_bags_of_rows_that_repeat_an_id(spark):
    rows = [(1, "b a b"), (1, "a c"), (2, None), (None, "a"), (None, "a d"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = vocab.bags(df, lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != ""))
    got = {r["doc_id"]: dict(zip(r["words"], r["n"])) for r in made.collect()}
    assert got == {1: {"a": 2, "b": 2, "c": 1}, None: {"a": 2, "d": 1}}
    assert {tuple(r) for r in vocab.counts_of(made).collect()} == {(i, w, n) for i, b in got.items() for w, n in b.items()}
    assert sorted(r["word"] for r in vocab.words_of(made).collect()) == ["a", "b", "c", "d"]


def test_topics_of_blocks_together(spark, monkeypatch):
    """Rows of a term are added up in the task, whatever the blocks that share it; the bound's rows pass through."""
    from docvec.operators import lda

    rng = np.random.default_rng(1)
    docs = [(i, sorted(rng.choice(30, 5, replace=False).tolist()), rng.integers(1, 4, 5).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, i array<bigint>, v array<double>").repartition(2, "doc_id").cache()
    monkeypatch.setattr(lda, "LEAST_ENTRIES", 40)
    monkeypatch.setattr(lda, "BLOCK_NUMBERS", 40)
    found = []
    for together in (1, 3):
        monkeypatch.setattr(lda, "TOGETHER", together, raising=False)
        m = lda.BatchLDA(3, 2, evaluate_every=1, perp_tol=0.0).fit(df)
        topics = {r["key"]: np.frombuffer(r["row"]) for r in m.topics.collect()}
        found.append((topics, m.perplexity_, {r["doc_id"]: r["vec"] for r in m.transform(df).collect()}))
    (a, p, x), (b, q, y) = found
    assert a.keys() == b.keys() and len(a) == 30 and x.keys() == y.keys() and len(x) == 300
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9)
    np.testing.assert_allclose(p, q, rtol=1e-9)
    np.testing.assert_allclose([x[i] for i in x], [y[i] for i in x], rtol=1e-9)

from collections import Counter, defaultdict

import numpy as np
import pytest

from docvec.llm import mixing


def plain_targets(sizes, weights, cap):
    """By bisection on the common level."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(cap * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total:
            low = mid
        else:
            high = mid
    return [min(cap * s, w * high) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(size):
    for key in (0, 1, 2**64 - 1):
        got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(got.tolist()) == list(range(size))
    if size > 1000:
        assert abs(np.corrcoef(np.arange(size), got)[0, 1]) < 0.1


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 10], [5, 0, 3, 900, 2, 1, 70], [0, 0], [7]])
def test_targets(spark, sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    table = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))],
                                  "sid int, source_size long, weight double")
    got = [r["target"] for r in mixing.targets(table).orderBy("sid").collect()]
    assert got == pytest.approx(plain_targets(sizes, weights, 3), abs=1e-6)


def rows_of(result):
    return sorted((tuple(r) for r in result.collect()), key=repr)


def test_query(spark, sf):
    from docvec.llm.queries import QUERIES

    rows = QUERIES["op2_mixing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    per = defaultdict(int)
    for d in docs:
        per[d["source"]] += size[d["doc_id"]]
    names = sorted(per)
    want = dict(zip(names, plain_targets([per[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 3),
                    strict=True))
    assert len(rows) == len(docs)
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for n in names:
        assert abs(taken[n] - want[n]) <= 2 * mixing.BLOCK_WORDS
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.02)
    assert rows_of(QUERIES["op2_mixing"](spark, sf)) == sorted((tuple(r) for r in rows), key=repr)  # reruns agree


def test_slots_blocks_and_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.plan(docs, block_words=16)
    sources = {r["sid"]: r for r in mix.sources.collect()}
    slots = mix.slots.toPandas()
    for sid, own in slots.groupby("sid"):
        s = sources[sid]
        assert len(own) == s["slots"]
        times = Counter(own["block"])
        full = s["slots"] // s["blocks"]
        assert set(times) <= set(range(s["blocks"])) and set(times.values()) <= {full, full + 1}
        assert not own[["shard", "slot"]].duplicated().any()
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mix).collect()}
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    words, whole = Counter(), {d["doc_id"]: d["text"] for d in docs.collect()}
    passes = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
        passes[r["doc_id"]] += r["text"] == whole[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == n for i, n in taken.items())
    assert all(passes[i] >= n // len(whole[i].encode().split()) for i, n in taken.items() if whole[i].split())


def test_rows_of_all_kinds(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (2, None, "s"), (3, "  ", "t"), (4, "w " * 5000, "t"),
            (None, None, None), (5, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 as taken", "2 as block", "3 as k1", "4 as row", "5 as mix_text", "6 as `pass`", "7 as n_chars")
    mix = mixing.plan(docs)
    got = mixing.taken(mix).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"]: r["source_size"] for r in got} == {"s": 6, None: 2, "t": 5000, "": 1}
    assert mixing.mixed_documents(docs, mix).columns == docs.columns
    mixing.mixed_documents(docs, mix).collect()
    empty = spark.createDataFrame([], docs.schema)
    none = mixing.plan(empty)
    assert mixing.taken(none).count() == 0 and mixing.mixed_documents(empty, none).count() == 0


def test_slots_are_made_in_many_tasks(spark, monkeypatch):
    """A few short rows say how many slots there are: their size must not put all slots into one task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "SHARD_SLOTS", 8)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 2)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 64, raising=False)
    docs = spark.createDataFrame([(i, "a b c d " * 16, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    slots = mixing.plan(docs).slots.withColumn("task", F.spark_partition_id())
    # counted where they lie
    per = [r["n"] for r in slots.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per) >= 290 and len(per) >= 3 and max(per) < 0.7 * sum(per)

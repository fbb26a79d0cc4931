from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__
import corpus_pipeline
from docvec.llm import bpe, langid, mixing, simhash


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mix", "tokens"]


def test_stages_against_plain_versions(spark, sf, tmp_path):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept.append((docs.collect(), out.collect()))
        docs = out
    (before, after) = kept[0]
    found = {r["doc_id"]: r["rejected"] for r in langid.predict(
        spark.read.parquet(f"{sf}/documents.parquet"), langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, bad in found.items() if not bad)
    assert len(after) > 0.98 * len(before)
    before, after = kept[1]
    fps = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 4) for r in before}
    alone = []
    seen = set()
    for i in sorted(fps):  # smallest first: a component goes as a whole
        if i in seen:
            continue
        alone.append(i)
        todo = [i]
        while todo:
            x = todo.pop()
            near = [j for j in fps if j not in seen and (fps[x] ^ fps[j]).bit_count() <= 4]
            seen.update(near)
            todo += near
    assert sorted(r["doc_id"] for r in after) == alone and len(after) < len(before)
    before, after = kept[2]
    first = {}
    texts = sorted((r["doc_id"], r["text"].encode()) for r in before)
    for i, t in texts:
        for s in range(len(t) - 49):
            first.setdefault(t[s:s + 50], i)
    got = {r["doc_id"]: r["text"] for r in after}
    for i, t in texts:
        goes = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s:s + 50]] < i:
                goes[s:s + 50] = b"\1" * 50
        assert got[i] == bytes(b for b, g in zip(t, goes, strict=True) if not g).decode("utf-8", "ignore")
    before, after = kept[3]
    words, size, source = Counter(), Counter(), {}
    for r in before:
        size[r["source"]] += len(r["text"].encode().split())
        source[r["doc_id"]] = r["source"]
    for r in after:
        words[r["source"]] += len(r["text"].encode().split())
    total = sum(size.values())
    assert abs(sum(words.values()) - total) < 0.02 * total
    assert all(words[s] <= 3 * size[s] for s in size)
    before, after = kept[4]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.VOCAB)), special_tokens={})
    texts = Counter((r["doc_id"], r["text"]) for r in before)
    got = Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in after)
    assert texts == got
    for r in after[:40]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(bytes(r["decoded"]).decode())


def test_run_and_rows_of_all_kinds(spark, tmp_path):
    rows = [(1, "a clean text of some words that goes on for a while", "en", "s", 51, "x"), (None, "the other text here", "en", None, 19, None),
            (2, None, None, None, None, None), (3, "", "de", "s", 0, "y"), (1, "a clean text of some words that goes on for a while", "en", "s", 51, "x"),
            (4, "noch ein Text mit Worten " * 2000, "de", "t", 50_000, "z"), (5, "noch ein Text mit Worten", "de", "t", 24, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `fp` string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in out.collect()) <= {1, None, 4, 5}
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

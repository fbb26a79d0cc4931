import random

import numpy as np
import xxhash

from docvec.llm import simhash
from docvec.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, distance):
    """Smallest id reachable, by comparing all pairs."""
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = ["", "  \n", "A b", "a b c d", "É Ü x\x0by\x1fz  w"] + [
        " ".join(rng.choice("aBcDé") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for part in (simhash.PART_BYTES, 7):
        monkeypatch.setattr(simhash, "PART_BYTES", part)
        for t in texts:
            for k in (1, 4):
                assert simhash.fingerprint(t.encode(), k) == plain_fingerprint(t, k)


def test_chains_lose_no_pair():
    rng = np.random.default_rng(2)
    for distance in (0, 1, 3, 4, 7):
        masks = simhash.key_masks(distance)
        for _ in range(400):
            a = rng.integers(0, 1 << 63, dtype=np.uint64)
            b = a
            for bit in rng.choice(64, distance, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            hits = [s for s, m in masks if not int(a ^ b) & m
                    and len(simhash.ring_matches(np.array([a]), np.array([b]), s, distance)[0])]
            assert hits, distance


def test_links_in_large_and_small_groups(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {0, centre}
    while len(fps) < 300:  # many fingerprints around one, dealt out in chunks
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    while len(fps) < 400:
        fps.add(rng.getrandbits(64))
    fps = sorted(fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    found = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), 4, block=32))
    got = {r["node"]: r["component"] for r in found.collect()}
    want = plain_components([(int(np.uint64(f).astype(np.int64)), f) for f in fps], 4)
    assert {n: c for n, c in want.items()} == {n: got.get(n, n) for n in want}


def test_rows_of_all_kinds(spark, sf):
    long = " ".join(f"w{i}" for i in range(500))
    rows = [(5, long, "a"), (3, long + " w", "b"), (9, None, "c"), (7, "", "d"), (None, long, "e"), (5, long, "f"), (8, "other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 7)]
    kept = sorted((r["doc_id"] or -1) for r in simhash.keep_first(docs).collect())
    assert kept == [-1, 3, 7, 8]
    assert simhash.keep_first(docs).columns == docs.columns
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_query(spark, sf):
    from docvec.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    want = plain_components(fps, 4)
    assert len(got) == len(docs)
    for i, f in fps:
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i]

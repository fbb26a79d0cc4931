import hashlib
import random

import numpy as np

from docvec.llm import editing


def walk(text):
    """One walk, step by step."""
    codes = [int(editing._mixed(np.array([ord(c)], np.uint64))[0] % np.uint64(255)) + 1 for c in text] + [0]
    steps = editing.STEPS_PER_CHAR * len(text)
    rate, levels, moves = editing._rate(steps), editing._levels(editing._power(steps)), editing._moves()
    at, out = 0, f"{editing._rate(steps):02x}"
    for j in range(steps):
        c = codes[at]
        if levels[j] >= rate:
            out += "0123456789abcdef"[(c - 1) % 15 + 1 if c else 0]
        at += moves[j % editing.PERIOD][c]
    return out


def test_walks():
    rng = random.Random(0)
    texts = ["", "a", "漢😀", "\x00\x00b"] + ["".join(rng.choices("abc é", k=rng.choice([2, 90, 700]))) for _ in range(30)]
    assert editing.fingerprints(texts) == [walk(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(1)
    texts = ["".join(rng.choices("etaoin shrdlu", k=n)) for n in (300, 1000, 4000) for _ in range(20)]
    prints = editing.fingerprints(texts)
    for edits, least in ((0, 1.0), (1, 0.9), (5, 0.7)):
        changed = []
        for t in texts:
            t = list(t)
            for _ in range(edits):
                t.insert(rng.randrange(len(t)), "q")
            changed.append("".join(t))
        near = [editing.likeness(a, b) for a, b in zip(prints, editing.fingerprints(changed), strict=True)]
        assert np.median(near) >= least and all(0 <= x <= 1 for x in near)
    far = [editing.likeness(a, b) for a, b in zip(prints, prints[1:])]
    assert np.median(far) < 0.3
    assert editing.likeness("00", "00") == 1.0 and editing.likeness("00", editing.fingerprints(["a"])[0]) == 0.0


def check(got, docs):
    """``got`` rows against plain slicing over ``docs`` in order."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + n[:cut]
        a, e, b = editing.fingerprints([t]) + editing.fingerprints([edited]) + editing.fingerprints([n])
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, editing.likeness(a, e), editing.likeness(a, b)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_query(spark, sf, monkeypatch):
    from docvec.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    monkeypatch.setattr(editing, "PARTITION_CHARS", 40_000)  # documents at many borders
    got = QUERIES["op6_fingerprint"](spark, sf).collect()
    check(got, docs)
    near, far = np.array([r["near_edited"] for r in got]), np.array([r["near_next"] for r in got])
    assert (near > far).mean() > 0.97


def test_rows_of_all_kinds(spark, monkeypatch):
    rows = [(1, "abcdefgh"), (1, "abcdefgh"), (None, "xyz é"), (None, None), (5, None), (6, ""), (9, "漢字" * 3000), (7, "abc"), (8, "a" * 40_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    for size in (1 << 24, 5000):
        monkeypatch.setattr(editing, "PARTITION_CHARS", size)
        check(editing.compare_next(docs).collect(), rows)
        check(editing.compare_next(docs.where("doc_id = 7")).collect(), [(7, "abc")])
        check(editing.compare_next(docs.where("doc_id is not null")).collect(), [r for r in rows if r[0] is not None])
    assert editing.compare_next(docs.where("false")).count() == 0


def test_near_groups(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("etaoin shrdlu", k=800)) for _ in range(12)]
    rows = []
    for g, t in enumerate(base):
        for v in range(5):
            at = rng.randrange(700)
            rows.append((g * 10 + v, t if v < 2 else t[:at] + "q" * v + t[at + v:]))
    prints = editing.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {}
    for r in editing.near_groups(prints, threshold=0.8).collect():
        groups.setdefault(r["group"], set()).add(r["doc_id"] // 10)
    assert all(len(x) == 1 for x in groups.values()) and len(groups) <= 14


def test_groups_over_a_shared_template_against_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    template = " ".join(word() for _ in range(180))
    texts = []
    for _ in range(40):  # pairs nearly equal, over a form that fills most of each text
        body = [word() for _ in range(110)]
        texts += [template + " " + " ".join(body), template + " " + " ".join([*body[:-3], word(), word(), word()])]
    prints = sorted(set(editing.fingerprints(texts)))
    wanted = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if editing.likeness(prints[i], prints[j]) >= 0.8:
                a, b = wanted[i], wanted[j]
                wanted = [min(a, b) if x in (a, b) else x for x in wanted]
    assert 30 < len(set(wanted)) < len(prints)  # families stay apart, their two texts are together
    u, v = editing.alike_forest(prints, 0.8)
    label = list(range(len(prints)))
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == wanted
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    for block in (512, 16):
        got = {r["doc_id"]: r["group"] for r in editing.near_groups(df, 0.8, block=block).collect()}
        assert len(set(got.values())) == len(set(wanted)) == len({(got[i], wanted[i]) for i in got})


def test_bands_find_nine_of_ten_near_pairs():
    rng = random.Random(8)
    found = near = 0
    for n in (30, 200, 900, 5000):
        for _ in range(60):
            t = "".join(rng.choices("etaoin shrdlu", k=n + rng.randrange(n // 4)))
            u = list(t)
            for _ in range(rng.randrange(1, max(2, len(t) // 25))):
                at = rng.randrange(len(u))
                u[at:at + rng.randrange(2)] = rng.choices("xyz", k=rng.randrange(2))
            a, b = editing.fingerprints([t, "".join(u)])
            if a != b and editing.likeness(a, b) >= 0.8:
                near += 1
                found += bool(set(editing.band_keys(a, 16, 6)) & set(editing.band_keys(b, 16, 6)))
    assert near > 60 and found >= 0.9 * near


def test_bands_draw_from_all_digits():
    t = "".join(random.Random(4).choices("etaoin shrdlu", k=3000))
    (a,) = editing.fingerprints([t])
    digits = a[2:]
    last = digits[:-20] + "".join("1" if d != "1" else "2" for d in digits[-20:])
    assert set(editing.band_keys(a, 64, 6)) != set(editing.band_keys(a[:2] + last, 64, 6))


def test_query_of_groups(spark, sf):
    from docvec.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["group"] for r in QUERIES["near_edit_groups"](spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in docs}
    prints = dict(zip([r["doc_id"] for r in docs], editing.fingerprints([r["text"] or "" for r in docs]), strict=True))
    names = sorted(set(prints.values()))
    u, v = editing.alike_forest(names, 0.8)
    label = list(range(len(names)))
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    wanted = {d: label[names.index(f)] for d, f in prints.items()}
    # no group holds texts that brute force keeps apart; nearly all of its links are found
    assert len({(got[d], wanted[d]) for d in got}) == len(set(got.values()))
    links, kept = len(wanted) - len(set(wanted.values())), len(got) - len(set(got.values()))
    assert kept >= 0.9 * links

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docvec.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, langs = Counter(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
    out = []
    for lang in langs:
        kept = [t for t in langs[lang] if docs[lang, t] >= min_docs]

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = share(langs[lang])
        p = {s: share(counts[lg, s]) for lg, s in counts if lg == lang}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, rank) for rank, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def found(spark, rows, min_docs=2, top=3):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n long, term string")
    return sorted(map(tuple, divergence.audit(docs, min_docs, top).collect()))


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "Ärger", "ärger", "x1y", "café", "日本", "a_b", "don't", "Z", "q" * 300] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 4 + ["a", "b", "ß", "c", None, ""])
        text = rng.choice([" ", ", ", "\x00", "-"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))
        rows.append((rng.choice([text] * 9 + [None]), rng.choice(["en", "en", "de", None]), source))
    return rows + rows[:10]


@pytest.mark.parametrize("blocks", [(32, 4096), (2, 3), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[1])
    rows = some_rows(blocks[1])
    assert found(spark, rows) == brute(rows, 2, 3)


def test_language_without_kept_terms_and_groups_without_terms(spark):
    rows = [("one", "xx", "a"), ("two", "xx", "b"), (None, "xx", "c"), ("", "yy", "only"),
            ("same same", "zz", "a"), ("same", "zz", "b"), ("42 !", "zz", "c")]
    got = found(spark, rows)
    assert got == brute(rows, 2, 3)
    assert {r[4] for r in got if r[0] == "xx"} == {0} and not [r for r in got if r[0] == "yy"]


def test_ties_go_by_bytes(spark):
    rows = [("b a é z", "en", s) for s in ("s1", "s1", "s2")] + [("b b a a é é", "en", "s3"), ("x", "en", "s4")]
    assert found(spark, rows, 1, 2) == brute(rows, 1, 2)


def test_empty_table(spark):
    assert found(spark, [("a", "b", "c")][:0]) == []


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 7)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abZé日 .1") for _ in range(rng.randint(0, 60)))
        got = [t for chunk in divergence.term_chunks(text.encode()) for t in chunk]
        assert got == [t.translate(LOWER).encode() for t in TERM.findall(text)]


def test_tasks_pass_counts_on_when_full(spark, monkeypatch):
    rows = some_rows(9)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    whole = sorted(divergence.counted(docs).collect())
    monkeypatch.setattr(divergence, "HELD_TERMS", 4)
    assert sorted(divergence.counted(docs).collect()) == whole


def test_probabilities_are_exact_for_large_counts(spark):
    big = [(3 * 10**13 + 1, 4 * 10**14 + 7, 10**9), (0, 1, 3), (10**15, 10**15, 1)]
    df = spark.createDataFrame(big, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.probability("n", "total", "v")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in big]


def test_cell_is_a_plain_sum():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 10**9, (3, 50)), rng.integers(0, 10**9, (4, 50))
    assert divergence.cell_divergences(a, b).tolist() == [[int(sum(abs(int(x) - int(y)) for x, y in zip(r, s))) for s in b] for r in a]

import zlib

import numpy as np
import pytest

from docvec.llm import langid


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").toPandas()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def plain_grams(text):
    """4-grams as strings: lower-case letters, other runs one space."""
    out, last = [], "\x01"
    chars = []
    for ch in text:
        c = ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " "
        if c == " " and last in " \x01":
            continue
        chars.append(c)
        last = c
    chars = ["\x01"] * 3 + chars
    return ["".join(chars[i - 3:i + 1]) for i in range(3, len(chars))], out


def test_grams():
    texts = ["", "Ab, c!", "  x", "--- 1", "Éa\nb" * 40, "\x01a"]
    key, which, letters = langid.grams([t.encode() for t in texts])
    for i, t in enumerate(texts):
        own = key[which == i].tolist()
        assert own == [sum(ord(c) << (16 * (3 - j)) for j, c in enumerate(g)) for g in plain_grams(t.replace("\x01", " "))[0]]
        assert letters[i] == sum(ch.isalpha() for ch in t)


def test_probabilities_sum_to_one_and_tables_agree(corpus):
    models = {}
    for lang in ("en", "de"):
        texts = [t.encode() for t in corpus[corpus.lang == lang].text[:60]]
        models[lang] = langid.kneser_ney(*np.unique(langid.grams(texts)[0], return_counts=True))
    for m in models.values():
        chars = m[0]["k"]
        for ctx in [*m[3]["contexts"][:5].tolist(), 0x0061_0062_7777]:
            some = (np.uint64(ctx) << np.uint64(16)) | chars
            other = langid._value(m, np.array([(ctx << 16) | 0xABCD], np.uint64), 4)[0]
            assert langid._value(m, some, 4).sum() + (65536 - len(chars)) * other == pytest.approx(1)
    merged = langid.merge_models(models)
    key, _, _ = langid.grams([corpus.text[3].encode(), "zq漢xx".encode()])
    got = merged.score(key)
    for j, lang in enumerate(merged.languages):
        assert np.allclose(got[:, j], np.log(langid._value(models[lang], key, 4)), atol=1e-4)


def test_query_on_held_out_documents(spark):
    from docvec.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_langid"](spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in tested)
    assert right / len(tested) > 0.97
    assert sum(r["rejected"] for r in got) < 0.01 * len(got)  # clean documents stay


def test_rows_of_all_kinds(spark, corpus):
    rows = [(i, t, x, 1) for i, t, x in corpus.head(120).itertuples(index=False)]
    rows += [(None, "the", "en", 1), (900, None, "en", 1), (901, "123 !!", None, 1), (902, "", "de", 1), (903, "漢字仮名" * 50, None, 1),
             (0, rows[0][1], rows[0][2], 1), (904, "x" * 2_500_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    models = langid.fit(docs)
    got = langid.predict(docs, models).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0
        else:
            assert r["lang_pred"] in models.languages
    assert {r["doc_id"] for r in got if r["rejected"]} >= {900, 901, 902, 903}
    kept = langid.accepted(docs, models)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        r["doc_id"] or -1 for r in got if not r["rejected"])
    empty = spark.createDataFrame([], docs.schema)
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert [r["lang_pred"] for r in langid.predict(docs.limit(1), None).collect()] == ["und"]
    assert langid.accepted(empty, models).count() == 0


def test_all_n_grams_of_many_languages_are_in_the_model(spark, monkeypatch):
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    texts = {f"l{i:03d}": ["".join(rng.choice(letters, 2500)) for _ in range(2)] for i in range(200)}
    rows = [(3 * i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts) if not held_out(3 * i)]
    counts = {lang: np.unique(langid.grams([t.encode() for _, t, x in rows if x == lang])[0], return_counts=True)
              for lang in {r[2] for r in rows}}
    assert min(len(k) for k, _ in counts.values()) > 2000
    wanted = langid.merge_models({lang: langid.kneser_ney(*c) for lang, c in counts.items()})
    monkeypatch.setattr(langid, "PART_CELLS", 100_000)
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.languages == wanted.languages
    key = langid.grams([rows[5][1].encode(), rows[50][1][::-1].encode(), "zq漢xx".encode()])[0]
    assert np.allclose(got.score(key), wanted.score(key), atol=1e-4)
    assert len(got.packs) > 5
    got.cells = langid.HELD_CELLS + 1  # the parts are loaded in turn
    assert np.allclose(got.score(key), wanted.score(key), atol=1e-4)


def test_rejection_of_rare_languages_and_with_a_mislabelled_text(spark, corpus):
    en, de = (corpus[corpus.lang == x].text.tolist()[:150] for x in ("en", "de"))
    train = [i for i in range(2000) if not held_out(i)]
    rows = [(i, t, "en") for i, t in zip(train, en + ["漢字仮名交文章" * 40], strict=False)]
    rows += [(i, t, "de") for i, t in zip(train[len(rows):], de, strict=False)]
    rows.append((train[len(rows)], "öå äø", "xx"))  # too short to calibrate on
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.isfinite(got.bounds).all()
    by = dict(zip(got.languages, got.bounds, strict=True))
    strange = got.entropies(["ሰላምታለሁላችሁእንኳንደህና".encode() * 20])[0][0]
    assert by["en"] < strange[got.languages.index("en")] and by["xx"] < strange.max()
    assert langid.decide(got, ["ሰላምታለሁላችሁእንኳንደህና".encode() * 20])[3].all()


def test_long_texts_read_in_pieces_have_the_same_grams(monkeypatch):
    rng = np.random.default_rng(3)
    letters = list("ab  .Éç漢\x01 ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))).encode() for _ in range(200)]
    whole = langid.grams(texts)
    monkeypatch.setattr(langid, "PIECE_BYTES", 7)
    key, which, n = langid.grams(texts)
    for i in range(len(texts)):
        assert key[which == i].tolist() == whole[0][whole[1] == i].tolist()
    assert n.tolist() == whole[2].tolist()

"""Dictionary steps from tables give what the literal ones give."""

from pyspark.sql import functions as F

from docvec.functions import text as T
from docvec.operators import dictionaries as D

ROWS = [(1, "We can't say it's of the kind of the old"), (2, None), (3, ""), (4, "the of the of the end"), (5, "a b c"),
        (6, "Running runs RAN better")]


def collected(df, col):
    return {r["doc_id"]: r[col] for r in df.collect()}


def test_tables_equal_literals(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    forms = {"can't": "can not", "it's": "it is"}
    table = spark.createDataFrame(list(forms.items()), "form string, expansion string")
    got = D.expand_contractions(docs, table).select("doc_id", T.preprocess("text").alias("t"))
    assert collected(got, "t") == collected(docs.select("doc_id", T.preprocess("text", contractions=forms).alias("t")), "t")

    toks = docs.select("doc_id", T.preprocess("text").alias("tokens"))
    phrases = [("of", "the"), ("the", "of", "the"), ("old",), ("kind", "of")]
    table = spark.createDataFrame([(list(p),) for p in phrases], "words array<string>")
    want = docs.select("doc_id", T.preprocess("text", phrases=[p for p in phrases if len(p) > 1]).alias("t"))
    assert collected(D.merge_phrases(toks, table), "tokens") == collected(want, "t")
    assert collected(D.merge_phrases(toks, table.where("false")), "tokens") == collected(toks, "tokens")

    stop = ["the", "of"]
    table = spark.createDataFrame([(w,) for w in stop], "word string")
    want = docs.select("doc_id", T.preprocess("text", remove_stopwords=True, stopwords=stop).alias("t"))
    assert collected(D.remove_stopwords(toks, table), "tokens") == collected(want, "t")

    lemmas = [("running", "n", "run"), ("run", "v", "ran"), ("better", "a", "good"), ("the", "v", "tha")]
    table = spark.createDataFrame(lemmas, "form string, pos string, lemma string")
    want = docs.select("doc_id", T.preprocess("text", lemmas=lemmas).alias("t"))
    assert collected(D.lemmatize(toks, table), "tokens") == collected(want, "t")


def test_empty_documents_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    toks = docs.select("doc_id", F.expr("cast(array() as array<string>)").alias("tokens"))
    words = spark.createDataFrame([("x",)], "word string")
    assert collected(D.remove_stopwords(toks, words), "tokens") == {i: [] for i, _ in ROWS}


def test_repeated_dictionary_rows_do_not_double_words(spark):
    docs = spark.createDataFrame([(1, "it isnt so")], "doc_id long, text string")
    forms = spark.createDataFrame([("isnt", "is not"), ("isnt", "is not"), ("isnt", "not is"), ("so", None)], "form string, expansion string")
    assert D.expand_contractions(docs, forms).first()["text"] == "it is not so"
    tokens = spark.createDataFrame([(1, ["mice", "ran"])], "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("mice", "n", "mouse"), ("mice", "n", "mouse"), ("ran", "v", "run"), ("ran", "v", "rin")],
                                   "form string, pos string, lemma string")
    assert D.lemmatize(tokens, lemmas).first()["tokens"] == ["mouse", "rin"]


def test_merging_holds_few_documents(spark):
    import pyarrow as pa

    n = 3 * D.MERGED + 5
    tokens = [["kind", "of", "old"]] * n
    matches = [[{"start": 0, "end": 2}, {"start": 1, "end": 3}] if i % 2 else None for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "tokens": tokens, "_m": matches})
    out = list(D._merged([batch]))
    assert max(map(len, out)) <= D.MERGED and sum(map(len, out)) == n
    got = [t for b in out for t in b.column("tokens").to_pylist()]
    assert got[:2] == [["kind", "of", "old"], ["kind of", "old"]]


def test_words_meet_a_dictionary_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 7)
    rows = [(i, ["running", "is", "better", f"w{i}"]) for i in range(20)] + [(3, ["mice", "running"]), (None, ["mice"]), (None, ["x"]), (30, [])]
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    lemmas = [("running", "n", "run"), ("run", "v", "ran"), ("better", "a", "good"), ("mice", "n", "mouse"), ("mouse", "a", None)]
    got = D.lemmatize(toks, spark.createDataFrame(lemmas, "form string, pos string, lemma string"))
    # each word of each document was a row that met the dictionary three times before
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append(r["tokens"])
    assert found.pop(None) == [[], []] and found.pop(30) == [[]]
    assert found.pop(3) == [["mouse", "ran", "is", "ran", "good", "w3"]] * 2
    assert found == {i: [["ran", "is", "good", f"w{i}"]] for i in range(20) if i != 3}

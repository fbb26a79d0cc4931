import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docvec.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(VOCAB, P.PATTERN)


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(VOCAB), special_tokens={})


def ids(enc, text):
    return np.frombuffer(enc.encode(text), "<u4").tolist()


def test_equals_library_on_random_texts(own, public):
    rng = random.Random(5)
    letters = "abcdefghij   \n\t'sé漢字😀́\x1c\x85 .,!?123²ⅣٱİſK​"
    for _ in range(1500):
        some = letters[:rng.choice([2, 3, 10, len(letters)])]
        text = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 40, 400])))
        assert ids(own, text) == public.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_001, " " * 30_001 + "x", "ab" * 20_000, "é" * 9_999, "!?" * 9_999, "<|endoftext|>"])
def test_one_long_piece(own, public, text):
    assert ids(own, text) == public.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_join_is_the_encoding_of_the_joined_bytes(own):
    rng = random.Random(6)
    for _ in range(2000):
        data = bytes(rng.choice(b"aehinorst ") for _ in range(rng.randint(2, 60)))
        cut = rng.randint(0, len(data))
        assert own.join(own.merge(data[:cut]), own.merge(data[cut:])) == own.merge(data)
        assert own.merge_long(data) == own.merge(data)


def test_rows_of_all_kinds(spark, public):
    rows = [(1, "one two", 1), (1, "one two", 2), (None, "x", 3), (2, None, 4), (3, "", 5), (4, "ß" * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    tokens = bpe.encode_documents(docs, VOCAB, P.PATTERN)
    got = bpe.decode_documents(tokens, VOCAB, P.PATTERN).collect()
    assert len(got) == len(rows)
    texts = {(i, t or "") for i, t, _ in rows}
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert (r["doc_id"], text) in texts
        assert np.frombuffer(r["ids"], "<u4").tolist() == public.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"]) // 4


def test_empty_table_and_query(spark, sf, public):
    from docvec.llm.queries import QUERIES

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, VOCAB, P.PATTERN).count() == 0
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = np.array(public.encode_ordinary(d["text"]), "<u4").tobytes()
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(want) // 4 and r["ids_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()

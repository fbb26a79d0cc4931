import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docvec.llm import tokencount

VOCAB = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return tokencount.counter(VOCAB)


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(VOCAB)


def library(public, text):
    return len(public.encode(text, add_special_tokens=False).ids)


def test_equals_library_on_random_texts(own, public):
    rng = random.Random(11)
    letters = "abcdefghij   \n\t'sé漢字😀́\x1c\x85 .,!?123²ⅣٱİſK​Ᲊ՘\U00010d40꟎\r\x0b　\x00"
    for _ in range(2000):
        some = rng.sample(letters, rng.choice([2, 3, 10, len(letters)]))
        text = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 40, 400])))
        assert own.count(text) == library(public, text), repr(text)


def test_every_code_point_is_classed_as_by_the_library(own, public):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}a1{c} {c}{c}" for c in points[at:at + 4096])
        assert own.count(text) == library(public, text), hex(at)


@pytest.mark.parametrize("text", [
    "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "<|ENDOFTEXT|>", " <|endoftext|>\n",
    "a" * 50_001, " " * 30_001 + "x", "ab" * 20_000, "é" * 9_999, "!?" * 9_999, "don't we'll I'M 'sx", "՘ Ᲊs",
])
def test_special_strings_and_long_pieces(own, public, text):
    assert own.count(text) == library(public, text)


def test_texts_beyond_the_list_bound(own, public, monkeypatch):
    monkeypatch.setattr(tokencount, "LIST_CHARS", 10)
    text = "The quick brown fox, déjà vu! " * 40
    assert own.count(text) == library(public, text)


def test_white_space_beside_spaces(own, public):
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b1", " ", " ", "\n", "\t", "'s", "\x1c", "\x85", "é", "!"]) for _ in range(rng.randint(0, 12)))
        assert own.count(text) == library(public, text), repr(text)


def test_full_cache_gives_the_same_counts(public, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_PIECES", 3)
    small = tokencount.Counter(VOCAB)
    text = "one two three four five six one two seven " * 5
    assert small.count(text) == library(public, text)
    assert len(small.pieces) <= 3 and len(small.pieces.old) <= 3


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        tokencount.Counter(P.path("word_bpe_49k.json"))


def test_rows(spark, public):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "a b", "n"),
            (4, "word " * 600, "l"), (5, "é" * 300, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokencount.count_tokens(docs, VOCAB, 512)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), library(public, r[1] or ""),
                   library(public, r[1] or "") > 512) for r in rows)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want
    assert tokencount.count_tokens(docs.limit(0), VOCAB, 512).count() == 0


def test_query_on_whole_table(spark, sf, public):
    from docvec.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_tokens"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = library(public, d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 512)

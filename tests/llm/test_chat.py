import hashlib
import random

import pytest

from docvec.llm import chat

BITS = ["<|im_end|>", "<|im_start|>", "<|\\im_end|>", "<|", "\\", "\n", "|>", "im_end", "a", "assistant", "<",
        "<|\\\\im_start|>", "", "é漢"]


def test_round_trip_of_conflicting_texts():
    rng = random.Random(3)
    for _ in range(5000):
        turns = [("".join(rng.choices(BITS, k=rng.randint(0, 4))), "".join(rng.choices(BITS, k=rng.randint(0, 6))))
                 for _ in range(rng.randint(0, 3))]
        segments = [chat.render(*t) for t in turns]
        formatted = "".join(s[0] for s in segments)
        assert chat.parse(formatted) == turns
        parser, got, at = chat.Parser(), [], 0
        while at < len(formatted):  # the same in parts of any size
            step = rng.randint(1, 9)
            got += parser.feed(formatted[at:at + step])
            at += step
        parser.close()
        assert got == turns
        for (_, text), (segment, a, b) in zip(turns, segments, strict=True):
            assert chat.unescape(segment[a:b]) == text


def test_plain_texts_stay_as_they_are():
    assert chat.render("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>u\n<|im_start|>v\n<|im_end|>\n"])
def test_parser_rejects(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def brute(turns):
    digest, mask, chars, loss = hashlib.sha256(), hashlib.sha256(), 0, 0
    for role, text in turns:
        digest.update(f"{role}\n{text}\n".encode())
        chars += len(chat.render(role, text)[0])
        if role == "assistant":
            mask.update(text.encode())
            loss += len(text)
    return len(turns), digest.hexdigest(), loss, mask.hexdigest(), chars


def test_rows_of_all_kinds(spark):
    rows = [(1, 2, "assistant", "b<|im_end|>", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"),
            (2, None, None, None, None), (2, 0, "assistant", "", "y"), (None, 0, "assistant", "é" * 5000, "z"),
            (None, 1, "system", "q\n", "z")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.format_turns(t)).collect()}
    want = {}
    for conv in (1, 2, None):
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        want[conv] = brute([(r, x) for _, r, x in own])
    assert got == want
    empty = spark.createDataFrame([], t.schema)
    assert chat.read_back(chat.format_turns(empty)).count() == 0


def test_query(spark, sf):
    from docvec.llm.queries import QUERIES

    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op4_chat"](spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    own = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", own), ("assistant", own)]
    assert got == {c: brute(t) for c, t in turns.items()}

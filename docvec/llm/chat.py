"""Chat formatting proven by a grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

A control string is `<|im_start|>` or `<|im_end|>`.  Inside a role or text such
a string is escaped by one backslash after `<|`, and one that already has
backslashes there gets one more; reading takes one away.  (A role also has
its backslashes and newlines escaped, as a newline ends it.)  Each turn is
rendered as it is, parsed back by the same deterministic parser that reads the
output, and escaped when the recovered turn is not identical to its source.

Output is one segment per turn; the formatted conversation is its segments in
order, so no conversation has to fit in one row.  The loss mask is the span of
an assistant's text in its segment.

Rows: a null role or text counts as empty; rows with a null conversation id
form one conversation; turns are ordered by (turn, role, text) with nulls
first, so ties and repeated rows have one order; an empty table gives an empty
result.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded, column

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|im_(?:start|end)\|>")
LITERAL = re.compile(r"<\|(\\*)(im_(?:start|end)\|>)")
ESCAPED = re.compile(r"<\|\\(\\*)(im_(?:start|end)\|>)")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return LITERAL.sub(r"<|\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<|\1\2", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


class Parser:
    """Deterministic parser of the grammar over text that comes in parts."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        """The (role, text) of each turn that is complete by now."""
        self.rest += part
        at = 0
        while True:
            end = CONTROL.search(self.rest, at + len(START))
            if not self.rest.startswith(START, at) or end is None or len(self.rest) <= end.end():
                break
            body = self.rest[at + len(START):end.start()]
            role, newline, text = body.partition("\n")
            if end[0] != END or not newline or self.rest[end.end()] != "\n":
                raise ValueError("the text does not follow the grammar")
            yield unescape_role(role), unescape(text)
            at = end.end() + 1
        self.rest = self.rest[at:]

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends inside a turn")


def parse(formatted: str) -> list[tuple[str, str]]:
    parser = Parser()
    turns = list(parser.feed(formatted))
    parser.close()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the text in it) of one turn."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        segment = f"{START}{r}\n{t}{END}\n"
        try:
            same = parse(segment) == [(role, text)]
        except ValueError:
            same = False
        if same:
            start = len(START) + len(r) + 1
            return segment, start, start + len(t)
    raise AssertionError("escaping both must give the turn back")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, segment, mask_start, mask_end): the formatted
    segment of each turn and the loss span in it (null but for assistants).
    One narrow pass."""
    rows = bounded(conversations).select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"),
        F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            made = [render(r, t) for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            masked = [r == LOSS_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if x else None for m, x in zip(made, masked, strict=True)], pa.int64()),
                 pa.array([m[2] if x else None for m, x in zip(made, masked, strict=True)], pa.int64())],
                names=["conv_id", "turn", "role", "text", "segment", "mask_start", "mask_end"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, segment string, "
                                "mask_start long, mask_end long")


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    found by parsing each formatted conversation and reading its loss spans.
    Turns of a conversation stream through one task in order; only the digest
    states and an unfinished turn are held, whatever the conversation's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        none = object()
        current, out, state = none, [], None

        def ended() -> None:
            state["parser"].close()
            out.append((current, state["turns"], state["digest"].hexdigest(), state["loss"],
                        state["mask"].hexdigest(), state["chars"]))

        def taken() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "mask_start", "mask_end")), strict=True)
            for conv, segment, a, b in rows:
                if conv != current or current is none:
                    if current is not none:
                        ended()
                    current = conv
                    state = {"parser": Parser(), "turns": 0, "digest": hashlib.sha256(), "loss": 0,
                             "mask": hashlib.sha256(), "chars": 0}
                for role, text in state["parser"].feed(segment):
                    state["turns"] += 1
                    state["digest"].update(f"{role}\n{text}\n".encode())
                state["chars"] += len(segment)
                if a is not None:
                    said = unescape(segment[a:b])
                    state["loss"] += len(said)
                    state["mask"].update(said.encode())
            yield taken()
            out.clear()
        if current is not none:
            ended()
            yield taken()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "mask_start", "mask_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

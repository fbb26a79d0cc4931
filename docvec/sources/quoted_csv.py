"""Quoted CSV files read by many tasks, line breaks in fields included.

A byte range cannot know whether it starts inside a quoted field.  A first pass
over the lines of every range therefore follows both cases and keeps, for each,
the case at the range's end and the number of records that start in it.  A scan
over the ranges (one small row each) settles the cases and the first record
number of every range; a second pass parses each range from its first record.
Only records that cross a border are put together from their pieces by a
shuffle.  Fields are split as Python's ``csv`` does; lines end in LF or CRLF.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

csv.field_size_limit(1 << 31)
SEPARATOR, QUOTE = b",", b'"'
OPENING = SEPARATOR + QUOTE


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, by whether one was
    before.  A quote opens a field only as its first character."""
    at = 0
    if not inside:
        if line.startswith(QUOTE):
            at = 1
        else:
            at = line.find(OPENING)
            if at < 0:
                return False
            at += 2
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == QUOTE:  # a doubled quote is text
            at += 2
            continue
        at = line.find(OPENING, at + 1)
        if at < 0:
            return False
        at += 2


def _fields(record: bytes) -> list[str]:
    return next(csv.reader([record.decode("utf-8", "replace")]), [])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes], bool]]:
    """(range, some of its lines, whether these are its first); the lines of a
    range come in order and in one task."""
    last = None
    for batch in batches:
        files, starts, lines = (batch.column(c).to_pylist() for c in ("file", "start", "line"))
        at = 0
        while at < len(lines):
            key, end = (files[at], starts[at]), at + 1
            while end < len(lines) and starts[end] == key[1] and files[end] == key[0]:
                end += 1
            yield key, lines[at:end], key != last
            last, at = key, end


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, inside0, records0, inside1, records1) of each range: the
    case at its end and the records that start in it, for either start."""
    rows: list[list] = []
    for key, lines, first in _by_range(batches):
        if first:
            rows.append([*key, False, 0, True, 0])
        row = rows[-1]
        for line in lines:
            blank, quoted = not line.rstrip(b"\r"), QUOTE in line
            for at in (2, 4):
                row[at + 1] += not row[at] and not blank
                if quoted:
                    row[at] = ends_inside(line, row[at])
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    cols = list(zip(*rows)) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                     names=["file", "start", "inside0", "records0", "inside1", "records1"])


def _pieces(lines: list[bytes], inside: bool, number: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """(record number, its lines, whether it ends here) from lines that start
    in this case; a record begun before has the number ``number - 1``."""
    held: list[bytes] = []
    for line in lines:
        if not inside and not line.rstrip(b"\r"):
            continue
        number += not inside
        held.append(line)
        inside = ends_inside(line, inside) if QUOTE in line else inside
        if not inside:
            yield number - 1, held, True
            held = []
    if held:
        yield number - 1, held, False


def quoted_records(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """((record long, fields array<string>), number of records) of a CSV file
    or a folder of them, without header.  Records are numbered from 0 in the
    order of the files' paths and of their lines; blank lines are none.  An
    open quote at a file's end ends there."""
    lines = _lines(spark, path)
    found = lines.mapInArrow(_ranges, "file string, start long, inside0 boolean, records0 long, inside1 boolean, records1 long")
    known: dict[tuple[str, int], tuple[bool, int]] = {}  # one entry a range, as many as the scan has splits
    inside, number, last, crossing = False, 0, None, False
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["start"])):
        inside = inside and r["file"] == last  # a file starts outside of quotes
        known[r["file"], r["start"]] = inside, number
        crossing |= inside
        number, inside, last = number + r[f"records{int(inside)}"], r[f"inside{int(inside)}"], r["file"]
    closing = {key for key, after in zip(known, [*list(known)[1:], None]) if after is None or after[0] != key[0]}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, bool]]:
        """(range, record number, its bytes here, whether all of it is here)"""
        key, held = None, []
        state = (False, 0)

        def rest() -> Iterator[tuple]:
            if held:
                # the last record of a file is whole even if its quote stays open
                yield key, state[1] - 1, b"\n".join(held), key in closing and not cut
        cut = False
        for here, some, first in _by_range(batches):
            if first:
                yield from rest()
                if here not in known:
                    raise RuntimeError(f"{here[0]} was split in another way by the second pass; read it again")
                key, held, state = here, [], known[here]
                cut = state[0]  # goes on with a record begun before this range
            for record, own, ended in _pieces(some, state[0] or bool(held), state[1]):
                held += own
                state = (not ended, record + 1)
                if ended:
                    yield key, record, b"\n".join(held), not cut
                    held, cut = [], False
        yield from rest()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, fields = [], []
        for _, record, raw, whole in walk(batches):
            if whole:
                numbers.append(record)
                fields.append(_fields(raw))
            if len(numbers) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(fields, pa.list_(pa.string()))],
                                                 names=["record", "fields"])
                numbers, fields = [], []
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(fields, pa.list_(pa.string()))],
                                         names=["record", "fields"])

    def torn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(record, key[1], raw) for key, record, raw, whole in walk(batches) if not whole]  # two a range at most
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.binary())], names=["record", "start", "raw"])

    out = lines.mapInArrow(parsed, "record long, fields array<string>")
    if crossing:
        pieces = lines.mapInArrow(torn, "record long, start long, raw binary").groupBy("record").agg(
            F.sort_array(F.collect_list(F.struct("start", "raw"))).alias("pieces"))  # the pieces of one record

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = [_fields(b"\n".join(p["raw"] for p in r)) for r in batch.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(whole, pa.list_(pa.string()))],
                                                 names=["record", "fields"])

        out = out.unionByName(pieces.mapInArrow(joined, "record long, fields array<string>"))
    return out, number

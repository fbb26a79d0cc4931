"""Blocks of rows that work on a table of parameters.

A model whose parameters do not fit one machine is a table (key, row): a
vector of numbers per term, word or feature, packed as little-endian doubles.
Rows of the corpus are packed into blocks of a bounded number of keys where
they lie; a block asks for the parameter rows of its own keys (one join),
computes on them with numpy, and sends back one row per key, which are added
up by key.  Neither the driver nor a task ever holds the whole table, and a
block's memory is bounded by its limit (or by a single longer row).

Blocks that ask for much the same rows get them together: neighbouring blocks
form a group of a bounded number of blocks, to which a row travels once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.session import written

HELD_NUMBERS = 1 << 23   # numbers of returned rows that a task adds up before it passes them on


# ---------------------------------------------------------------- rows of numbers
def matrix(rows: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The packed rows of a binary column (none of them null) as one matrix."""
    return _numbers(_raw(rows, width), width)


def _raw(rows: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The bytes of packed rows, a line each where all are of one kind, else their numbers."""
    if isinstance(rows, pa.ChunkedArray):
        parts = [_raw(c, width) for c in rows.chunks if len(c)]
        if len({(x.dtype, x.shape[1]) for x in parts}) > 1:
            parts = [_numbers(x, width) for x in parts]
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((0, width))
    if not len(rows):
        return np.zeros((0, width))
    kind = np.int64 if pa.types.is_large_binary(rows.type) else np.int32
    offsets = np.frombuffer(rows.buffers()[1], kind)[rows.offset:rows.offset + len(rows) + 1]
    sizes = np.diff(offsets)
    if (sizes == sizes[0]).all():
        data = rows.buffers()[2] or b""
        return np.frombuffer(data, np.uint8)[int(offsets[0]):int(offsets[-1])].reshape(len(rows), int(sizes[0]))
    out = np.zeros((len(rows), width))
    for size in np.unique(sizes):
        out[sizes == size] = matrix(rows.filter(pa.array(sizes == size)), width)
    return out


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    """The numbers of packed rows, which are doubles, or narrow (``narrow_row``)."""
    if raw.dtype != np.uint8:
        return raw
    if raw.shape[1] == 8 * width:
        return np.ascontiguousarray(raw).view("<f8")
    if raw.shape[1] != 4 * width + 4:
        raise ValueError(f"a row of {raw.shape[1]} bytes does not hold {width} numbers")
    out = np.empty((len(raw), width))
    out[:, :-1] = np.ascontiguousarray(raw[:, :-8]).view("<f4")
    out[:, -1:] = np.ascontiguousarray(raw[:, -8:]).view("<f8")
    return out


def packed_rows(m: np.ndarray) -> pa.Array:
    """One binary value per row of the matrix."""
    m = np.ascontiguousarray(m, "<f8")
    data = pa.py_buffer(m.reshape(-1).view(np.uint8)) if m.size else pa.py_buffer(b"")
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * 8 if m.ndim > 1 else 8)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.tobytes()), data])


def row_of(column: str | Column) -> Column:
    """Column: an array of numbers as a packed row."""
    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: np.asarray(a, "<f8").tobytes())

    return pack((F.col(column) if isinstance(column, str) else column).cast("array<double>"))


def narrow_row(column: str | Column) -> Column:
    """Column: an array of numbers as a packed row of half the size, if all but
    the last are exactly floats (as word vectors mostly are); else as ``row_of``."""
    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        def one(a) -> bytes:
            a = np.asarray(a, "<f8")
            with np.errstate(over="ignore"):
                short = a[:-1].astype("<f4")
            return short.tobytes() + a[-1:].tobytes() if len(a) > 1 and (short == a[:-1]).all() else a.tobytes()

        return arrays.map(one)

    return pack((F.col(column) if isinstance(column, str) else column).cast("array<double>"))


def array_of(column: str = "row") -> Column:
    """Column: a packed row as array<double>."""
    @F.pandas_udf("array<double>")
    def unpack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: np.frombuffer(b, "<f8"))

    return unpack(F.col(column))


# ---------------------------------------------------------------- packing
def packed(df: DataFrame, keys: str, limit: int, split: bool = False, most_rows: int | None = None) -> DataFrame:
    """(block long, rows binary, keys array): consecutive rows of ``df`` whose
    column ``keys`` (an array of longs or strings) holds about ``limit``
    entries.  ``rows`` is the Arrow form of the rows with ``keys`` replaced by
    positions in the block's list of distinct keys.  With ``split``, a row with
    more entries is cut into several rows, equal in their other columns; with
    ``most_rows``, a block has no more rows than that (where a row's result is wide).

    The blocks follow the order in which rows lie, so they are materialised."""
    at = [f.name for f in df.schema.fields].index(keys)
    kind = df.schema[keys].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []
        entries = lying = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column(at).chunk(0)
            coded = pc.dictionary_encode(lists.flatten())
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            places = pa.ListArray.from_arrays(_offsets(lists), coded.indices.cast(pa.int32()))
            sink = pa.BufferOutputStream()
            out = table.set_column(at, keys, places)
            with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)],
                names=["block", "rows", "keys"])

        for batch in batches:
            lists = batch.column(at)
            size = np.diff(_offsets(lists).to_numpy()) + 1  # a row without keys takes room too
            start = 0
            while start < len(batch):
                # as many rows as still fit, at least one
                fit = int(np.searchsorted(np.cumsum(size[start:]), limit - entries, side="right"))
                if most_rows is not None:
                    fit = min(fit, most_rows - lying)
                if not fit and not held:
                    if split and size[start] - 1 > limit:
                        for a in range(0, int(size[start]) - 1, limit):
                            piece = pa.array([lists[start].as_py()[a:a + limit]], lists.type)
                            held = [batch.slice(start, 1).set_column(at, batch.schema.field(at), piece)]
                            yield flush()
                            number += 1
                        held, start = [], start + 1
                        continue
                    fit = 1
                if fit:
                    held.append(batch.slice(start, fit))
                    entries += int(size[start:start + fit].sum())
                    lying += fit
                    start += fit
                if start < len(batch) or entries >= limit:
                    yield flush()
                    held, entries, lying, number = [], 0, 0, number + 1
        if held:
            yield flush()

    rows = df.withColumn(keys, F.coalesce(F.col(keys), F.expr(f"cast(array() as array<{kind}>)")))
    return written(rows.mapInArrow(run, f"block long, rows binary, keys array<{kind}>"))


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets that start at 0, also for a slice."""
    o = lists.offsets.to_numpy()[: len(lists) + 1] if lists.offset == 0 else np.append(
        0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    return pa.array((o - o[0]).astype(np.int32))


class Block:
    """What a block computes on: its rows, and the parameter rows of its keys."""

    def __init__(self, number: int, rows: bytes, keys: pa.Array, found: pa.Table, width: int,
                 decode: Callable[[np.ndarray], np.ndarray] | None = None):
        at = pc.index_in(found.column("key").combine_chunks(), value_set=keys)
        if isinstance(at, pa.ChunkedArray):
            at = at.combine_chunks()
        m = matrix(found.column("row"), width)
        self._hold(number, rows, keys, at.to_numpy(zero_copy_only=False).astype(np.int64), m if decode is None else decode(m))

    @classmethod
    def given(cls, number: int, rows: bytes, keys: pa.Array, place: np.ndarray, m: np.ndarray) -> "Block":
        """A block whose parameter rows ``m`` belong to the keys at ``place``."""
        block = cls.__new__(cls)
        block._hold(number, rows, keys, place, m)
        return block

    def _hold(self, number: int, rows: bytes, keys: pa.Array, place: np.ndarray, m: np.ndarray) -> None:
        self.number = number
        self.table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.keys = keys
        self._place, self._rows = place, m
        #: parameters by position in ``keys``; rows of zeros for keys that the table does not have
        self.params = np.zeros((len(keys), m.shape[1]))
        self.params[place] = m
        self.known = np.zeros(len(keys), bool)
        self.known[place] = True

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """(parameters, times): rows of a key that the table has more than once
        added up, and how often it has each key."""
        times = np.bincount(self._place, minlength=len(self.keys))
        if times.max(initial=0) <= 1:
            return self.params, times
        out = np.zeros_like(self.params)
        np.add.at(out, self._place, self._rows)
        return out, times

    def matches(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, at, rows): what a join of the entries at ``place`` with the
        table gives, as entries of ``place`` and rows of the matrix ``rows``."""
        order = np.argsort(self._place, kind="stable")
        times = np.bincount(self._place, minlength=len(self.keys))
        n = times[place]
        at = order[_ranges((np.cumsum(times) - times)[place], n)]
        return np.repeat(np.arange(len(place)), n), at, self._rows

    def lists(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values) of a list column."""
        if not len(self.table):
            return np.zeros(1, np.int64), np.zeros(0)
        column = self.table.column(name).chunk(0)
        return _offsets(column).to_numpy().astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


# ---------------------------------------------------------------- pull and push
def pull(blocks: DataFrame, params: DataFrame) -> DataFrame:
    """(to, key, row): for each block the parameter rows of its keys."""
    asked = blocks.select(F.col("block").alias("to"), F.explode("keys").alias("key"))
    return asked.join(params.select("key", "row"), "key").select("to", "key", "row")


class _Taken:
    """Packed rows as they came, in pieces: taken by number, never copied as a whole."""

    def __init__(self, rows: pa.ChunkedArray, width: int):
        self.width = width
        self.parts = [_raw(c, width) for c in rows.chunks if len(c)]
        if len({(x.dtype, x.shape[1]) for x in self.parts}) > 1:
            self.parts = [_numbers(x, width) for x in self.parts]
        self.first = np.cumsum([0] + [len(x) for x in self.parts])[:-1]

    def take(self, at: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.zeros((0, self.width))
        out = np.empty((len(at), self.parts[0].shape[1]), self.parts[0].dtype)
        part = np.searchsorted(self.first, at, side="right") - 1
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(len(self.parts) + 1))
        for x, first, a, e in zip(self.parts, self.first, cuts[:-1], cuts[1:], strict=True):
            out[order[a:e]] = x[at[order[a:e]] - first]
        return _numbers(out, self.width)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``first`` on, one run after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def in_groups(blocks: DataFrame, together: int) -> DataFrame | None:
    """``blocks`` of ``packed`` with ``group``: up to ``together`` neighbouring
    blocks each, but a group per core at least; None if that is a block each."""
    if together <= 1:
        return None
    part = F.shiftright("block", 40)
    # a row per task that packed
    sizes = {r["part"]: r["n"] for r in blocks.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    per = min(together, sum(sizes.values()) // max(1, blocks.sparkSession.sparkContext.defaultParallelism))
    if per <= 1:
        return None
    n = [sizes.get(i, 0) for i in range(max(sizes) + 1)]
    before = ", ".join(f"{x}L" for x in np.cumsum(n) - n)
    at = F.element_at(F.expr(f"array({before})"), (part + 1).cast("int")) + F.expr(f"block & {(1 << 40) - 1}L")
    return blocks.withColumn("group", F.floor(at / F.lit(per)).cast("long"))


def on_blocks(blocks: DataFrame, params: DataFrame, width: int, fn: Callable[[Block], pa.Table], schema: str, together: int = 1,
              decode: Callable[[np.ndarray], np.ndarray] | None = None, adds: int = 0) -> DataFrame:
    """``fn`` on every block and the parameter rows of its keys; ``decode`` makes
    the rows that it gets of those that travel.  Up to ``together`` blocks get
    their rows together and are worked on one after the other: a task holds the
    rows of their keys as they travel, and the blocks' results.  With ``adds``
    these are rows (key long, row) of so many numbers, and those of a key that
    the blocks asked for are added up before they leave the task."""
    grouped = in_groups(blocks, together)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys = left.column("keys").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        block = Block(key[0].as_py(), left.column("rows")[0].as_py(), keys.flatten(), right, width, decode)
        return fn(block)

    if grouped is None:
        return blocks.groupBy("block").cogroup(pull(blocks, params).groupBy("to")).applyInArrow(run, schema)

    def run_group(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = _whole(left.column("keys"))
        found = pc.dictionary_encode(_whole(right.column("key")))
        code, names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        rows_of = _Taken(right.column("row"), width)
        order = np.argsort(code, kind="stable")
        times = np.append(np.bincount(code, minlength=len(names)), 0)   # the last for keys that the table does not have
        first = np.cumsum(times) - times
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), len(names)).to_numpy().astype(np.int64)
        cuts = _offsets(lists).to_numpy()
        numbers, rows, out = left.column("block").to_numpy(), left.column("rows"), []
        sums = np.zeros((len(names), adds)) if adds else None
        for j in np.argsort(numbers, kind="stable").tolist():
            mine = at[cuts[j]:cuts[j + 1]]
            m = rows_of.take(order[_ranges(first[mine], times[mine])])
            made = fn(Block.given(int(numbers[j]), rows[j].as_py(), lists[j].values, np.repeat(np.arange(len(mine)), times[mine]),
                                  m if decode is None else decode(m)))
            if adds:
                place = pc.fill_null(pc.index_in(_whole(made.column("key")), value_set=names), -1).to_numpy()
                known = np.flatnonzero(place >= 0)   # a block returns a key once
                sums[place[known]] += matrix(made.column("row"), adds)[known]
                made = made.take(pa.array(np.flatnonzero(place < 0)))
            out.append(made)
        if adds:
            out.append(pa.table({"key": names.cast(pa.int64()), "row": packed_rows(sums)}))
        return pa.concat_tables(out, promote_options="default")

    asked = grouped.select(F.col("group").alias("to"), F.explode("keys").alias("key")).distinct()
    pulled = asked.join(params.select("key", "row"), "key").select("to", "key", "row")
    return grouped.groupBy("group").cogroup(pulled.groupBy("to")).applyInArrow(run_group, schema)


def _runs(keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal neighbouring keys added up."""
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cut], np.add.reduceat(m, cut, axis=0)


def combined(parts: DataFrame, width: int) -> DataFrame:
    """(key, row) with rows of equal keys added up as far as they meet in a
    task: a frequent key then leaves a task once, not once per block."""
    limit = max(1, HELD_NUMBERS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            k, m = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(k, kind="stable")
            k, m = _runs(k[order], m[order])
            return pa.RecordBatch.from_arrays([pa.array(k), packed_rows(m)], names=["key", "row"])

        for batch in batches:
            if not len(batch):
                continue
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            rows.append(matrix(batch.column("row"), width))
            held += len(batch)
            if held >= limit:
                yield flush()
                keys.clear()
                rows.clear()
                held = 0
        if keys:
            yield flush()

    return parts.select("key", "row").mapInArrow(run, "key long, row binary")


def added(parts: DataFrame, width: int, finish: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key long, row): the sum of the rows of each key, in the order of a
    sorted stream, so that a task holds one batch; ``finish(keys, sums)`` is
    applied to the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None

        def out(keys: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            if finish is not None:
                m = finish(keys, m)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), packed_rows(m)], names=["key", "row"])

        for batch in batches:
            if not len(batch):
                continue
            keys, m = _runs(batch.column("key").to_numpy(zero_copy_only=False), matrix(batch.column("row"), width))
            if last_key is not None:
                if keys[0] == last_key:
                    m[0] += last
                else:
                    yield out(np.array([last_key]), last[None, :])
            last_key, last = keys[-1], m[-1].copy()
            if len(keys) > 1:
                yield out(keys[:-1], m[:-1])
        if last_key is not None:
            yield out(np.array([last_key]), last[None, :])

    return combined(parts, width).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, row binary")


def total(params: DataFrame, width: int, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all parameter rows of ``fn(matrix of rows) -> size numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if len(batch):
                out += fn(matrix(batch.column("row"), width))
        yield pa.RecordBatch.from_arrays([packed_rows(out[None, :])], names=["row"])

    rows = params.select("row").mapInArrow(run, "row binary").withColumn("share", F.spark_partition_id() % 64)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"row": packed_rows(matrix(table.column("row"), size).sum(axis=0)[None, :])})

    # a row per task, then one per share: at most 64 rows of ``size`` numbers come to the driver
    found = rows.groupBy("share").applyInArrow(add, "row binary").collect()
    return sum((np.frombuffer(r["row"], "<f8") for r in found), np.zeros(size))

"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encodings of byte strings form a monoid: two neighbours are joined by
re-encoding a small window of tokens around their boundary.  A token
sequence is the encoding of its bytes exactly when each adjacent pair of
tokens is the encoding of its own bytes (the first merge across a token
border would also happen in that pair alone).  So a join is proven right as
soon as the two seams between the window and the tokens outside it are such
pairs; else the window doubles.  Windows are merged with a heap, so a piece
of any length costs O(n log^2 n) at worst, never the square.

Rows: null text counts as empty; repeated rows and repeated ids are each
encoded on their own; an empty table gives an empty result; null ids stay
null.  Only (id, text) are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docvec.llm.common import slices, text_rows

LEAF_BYTES = 8           # byte strings up to this length are merged directly
CACHE_PIECES = 1 << 17   # pieces kept per Python worker, in each of two generations
CACHE_SMALL = 1 << 16    # short byte strings and token pairs kept
SLICE_BYTES = 2 << 20   # text handled at once
DECODE_LEAF = 4096       # ids joined at once at the leaves of the decoding tree


class TreeEncoder:
    """Ranks of one vocabulary and the tree reduction over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._small: dict[bytes, tuple] = {}
        self._pairs: dict[tuple, bool] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    # -- leaves ---------------------------------------------------------
    def merge(self, data: bytes) -> tuple:
        """Direct merging, lowest rank first and leftmost among equals."""
        if len(data) > 8 * LEAF_BYTES:
            return self.merge_long(data)
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple([ranks[p] for p in parts])

    def merge_long(self, data: bytes) -> tuple:
        """The same merging for a window that had to grow wide: a heap of
        (rank, position) over linked parts, O(n log n)."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part = [data[i:i + 1] for i in range(n)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != r:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = part[i] + part[j], None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := ranks.get(part[i] + part[j])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h))
        return tuple([ranks[p] for p in part if p is not None])

    def small(self, data: bytes) -> tuple:
        got = self._small.get(data)
        if got is None:
            if len(self._small) >= CACHE_SMALL:
                self._small.clear()
            got = self._small[data] = self.merge(data)
        return got

    # -- the monoid -----------------------------------------------------
    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joined bytes."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= CACHE_SMALL:
                self._pairs.clear()
            got = self._pairs[(a, b)] = self.merge(self.tokens[a] + self.tokens[b]) == (a, b)
        return got

    def join(self, left: tuple, right: tuple) -> tuple:
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = left[max(0, len(left) - width):], right[:width]
            data = b"".join([self.tokens[t] for t in a + b])
            middle = self.small(data) if len(data) <= 2 * LEAF_BYTES else self.merge(data)
            outer_left, outer_right = left[:len(left) - len(a)], right[len(b):]
            if (not outer_left or self.stable(outer_left[-1], middle[0])) and (
                    not outer_right or self.stable(middle[-1], outer_right[0])):
                return outer_left + middle + outer_right
            width *= 2

    def reduce(self, data: bytes) -> tuple:
        if len(data) <= LEAF_BYTES:
            return self.small(data)
        cut = len(data) // 2
        return self.join(self.reduce(data[:cut]), self.reduce(data[cut:]))

    # -- texts ----------------------------------------------------------
    def piece(self, piece: str) -> bytes:
        """Ids of one pattern match as little-endian unsigned 32-bit integers."""
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else self.reduce(data)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        new, old, out = self._new, self._old, []
        for piece in self.pattern.findall(text):
            got = new.get(piece)
            if got is None:
                got = old.get(piece)
                if got is None:
                    got = self.piece(piece)
                if len(piece) <= 64:
                    if len(new) >= CACHE_PIECES:  # the older generation goes
                        self._old, self._new = old, new = new, {}
                    new[piece] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Concatenate token bytes up a balanced tree."""
        values = np.frombuffer(ids, "<u4")
        level = [b"".join(map(self.tokens.__getitem__, values[i:i + DECODE_LEAF].tolist()))
                 for i in range(0, len(values), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 16]) for i in range(0, len(level), 16)]
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder per Python worker; the vocabulary file is read there."""
    return TreeEncoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary): every whole text, each match of
    ``pattern`` encoded separately, no special tokens.  ``ids`` are
    little-endian unsigned 32-bit integers.  One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, pattern)
        for part in slices(batches, limit=SLICE_BYTES):
            ids = [enc.encode(t.decode("utf-8", "replace")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def decode_documents(tokens: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded binary) from ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, pattern)
        for part in slices(batches, "ids", SLICE_BYTES):
            out = [enc.decode(x or b"") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded binary): encoding and decoding of the ids
    it gives in one pass, which takes one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, pattern)
        for part in slices(batches, limit=SLICE_BYTES):
            ids = [enc.encode(t.decode("utf-8", "replace")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([enc.decode(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary")

"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol per byte, linked to its neighbours.  All
adjacent pairs that a merge rule knows lie in a heap by (rank, position); the
lowest is popped again and again, its right symbol is unlinked and the pairs
that the new symbol makes with its neighbours are pushed.  An entry whose
symbols have changed since it was pushed is passed over.  Each merge removes
one symbol, so a piece has as many tokens as bytes minus merges: no
identifiers are written down.

A vocabulary is a tokenizer file in JSON (byte-level BPE): its merge rules,
its added tokens (each occurrence in a text is one token, and the text is cut
there) and its pattern of pieces.  Letters and digits are those of the
tokenizer library's Unicode version: each character not met before is put to
the library once, and one that our pattern engine would class otherwise is
replaced by a stand-in of the right class before the text is cut.

Rows: null text counts as empty (0 bytes, 0 tokens); repeated rows and
repeated ids are each counted; an empty table gives an empty result; null ids
stay null.  Only (id, text) are read, so other columns may have any name.
A piece of any length costs O(n log n) time and about 60 bytes of memory per byte.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docvec.llm.common import slices, text_rows

CACHE_PIECES = 1 << 17   # pieces kept per Python worker, in each of two generations
CACHE_LENGTH = 64        # longer pieces are not kept
LIST_CHARS = 1 << 20     # texts up to this length are cut into a list at once
UNSAFE = 1 << 62         # more than any count
WIDE_BYTES = 1 << 12     # longer pieces are kept in compact arrays
GONE = 1 << 30           # the symbol of an unlinked place: no rule knows it

# Fixed value: the published pattern of byte-level BPE pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A character of each class that no other alternative of PIECES names.
STAND_IN = {"letter": "q", "digit": "0", "space": "\t", "other": "!"}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such files:
    printable Latin-1 bytes for themselves, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens of texts; pieces met often are remembered."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
                 and not model.get("dropout") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix"))
        added = spec["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocab = model["vocab"]
        self.start = [0] * 256
        for char, byte in byte_symbols().items():
            self.start[byte] = vocab[char]
        #: rank of each (left symbol, right symbol), in one integer, and the symbol that each rank makes
        self.ranks: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, rule in enumerate(model["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.makes.append(vocab[left + right])
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.find = regex.compile(PIECES)
        self.pieces = _Kept(lambda piece: self.merged(piece.encode("utf-8")))
        self.words = _Kept(lambda word: self._words(word, " "))
        self._known: set[str] = set()
        self._replaced: dict[str, str] = {}

    def merged(self, data: bytes) -> int:
        """Tokens of one piece: its symbols minus the merges made."""
        n = len(data)
        ranks, makes, start = self.ranks.get, self.makes, self.start
        symbol, after, before = [start[b] for b in data], range(1, n + 1), range(-1, n - 1)
        if n > WIDE_BYTES:
            symbol, after, before = array("q", symbol), array("q", after), array("q", before)
        else:
            after, before = list(after), list(before)
        bits = n.bit_length()  # an entry is rank << bits | position
        place = (1 << bits) - 1
        heap = [rank << bits | i for i in range(n - 1)
                if (rank := ranks(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapify(heap)
        made = 0
        while heap:
            entry = heappop(heap)
            i, rank = entry & place, entry >> bits
            j = after[i]
            if j >= n or ranks(symbol[i] << 32 | symbol[j]) != rank:
                continue  # one of the two has become another symbol
            made += 1
            new = symbol[i] = makes[rank]
            symbol[j] = GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks(new << 32 | symbol[k])) is not None:
                    heappush(heap, rank << bits | i)
            h = before[i]
            if h >= 0 and (rank := ranks(symbol[h] << 32 | new)) is not None:
                heappush(heap, rank << bits | h)
        return n - made

    def _meet(self, chars: set[str]) -> None:
        """Ask the library for the class of characters not met before."""
        from tokenizers import pre_tokenizers

        library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        for char in chars:
            # behind "a" a letter goes on with it; then "0" or "!" go on with a digit or with anything else
            probe = f"a{char}a0{char}0!{char}!"
            spans = {span for _, span in library.pre_tokenize_str(probe)}
            if spans != {m.span() for m in self.find.finditer(probe)}:
                kind = ("letter" if (0, 3) in spans else "digit" if (3, 6) in spans
                        else "other" if (6, 9) in spans else "space")
                self._replaced[char] = STAND_IN[kind]
        self._known |= chars

    def _cut(self, text: str) -> Iterator[str]:
        """The pieces of a text with characters that our pattern engine
        classes otherwise than the library."""
        table = str.maketrans(self._replaced)
        for m in self.find.finditer(text.translate(table)):
            yield text[m.start():m.end()]

    def _plain(self, text: str) -> int:
        if not text.isascii():
            chars = set(text)
            if not chars <= self._known:
                self._meet(chars - self._known)
            if self._replaced and not self._replaced.keys().isdisjoint(chars):
                return sum(map(self.pieces.__getitem__, self._cut(text)))
        if len(text) <= LIST_CHARS:
            # a space between two other characters starts a piece, so words can be counted apart
            first, *words = text.split(" ")
            total = self._words(first) + sum(map(self.words.__getitem__, words)) if words else UNSAFE
            return total if total < UNSAFE else self._pieces_of(text)
        return sum(self.pieces[m.group()] for m in self.find.finditer(text))

    def _pieces_of(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find.findall(text)))

    def _words(self, word: str, before: str = "") -> int:
        """Tokens of a word between spaces, with the space before it; UNSAFE if
        white space at its ends could be one piece with those spaces."""
        if not word or word[0].isspace() or word[-1].isspace():
            return UNSAFE
        return self._pieces_of(before + word)

    def count(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self._plain(text[at:m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


class _Kept(dict):
    """Numbers by string; at CACHE_PIECES entries the older half goes."""

    def __init__(self, make: Callable[[str], int]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> int:
        n = self.old.get(key)
        if n is None:
            n = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[key] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per Python worker; the vocabulary file is read there."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocab: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes long, n_tokens long, over_limit boolean): tokens of
    every whole text by the vocabulary file ``vocab``, and whether there are
    more than ``limit``.  One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocab)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            n = [own.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

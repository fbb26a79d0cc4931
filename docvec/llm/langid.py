"""Language identification by interpolated Kneser-Ney character models.

For each language the counts of all character 4-grams of all its training
texts are gathered with one Spark aggregation (partial sums per task first).
From all of them Spark aggregations and joins make one interpolated Kneser-Ney
model per language: the highest order from counts, the lower ones from the
numbers of distinct left neighbours.  The model goes to tasks in parts of a
bounded size, in the order in which a text's n-grams meet them; a part has a
sorted array of 64-bit hashes, and beside it the log probability or back-off
weight in each language that has the n-gram.  A task that cannot hold all the
parts loads them in turn.  A text goes to the language with the lowest
cross-entropy per character.  It is rejected when that entropy is above the
language's calibrated bound, found from quantiles over all its training texts;
a language with few of them has at least the bound of all languages together.

Characters are lower-cased letters, every run of others is one space; so case,
digits, symbols and mark-up are no evidence.

Rows: a text that is null or has no letter gets `und`, score 0 and is rejected;
rows with a null id are scored but never learned from; repeated rows are scored
each on their own; ties go to the language first in code point order.  Without
training rows every text is `und`.  Only (id, text, lang) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import bounded, column, slices, text_rows
from docvec.session import cut_lineage

ORDER = 4
SPACE, START = 0x20, 0x01
PIECE_BYTES = 1 << 20      # a longer text is read in pieces of about this size
SLICE_BYTES = 2 << 20      # text handled at once in a task
FLUSH_TYPES = 1 << 20      # distinct n-grams that a counting task holds
PART_CELLS = 1 << 22       # (n-gram, language) cells of one part of the model
HELD_CELLS = 1 << 23       # cells of all parts up to which a task keeps them loaded
SCORE_CELLS = 1 << 23      # (n-gram, language) scores that a task holds at once
CALIBRATION_DOCS = 30      # with fewer training texts a language has at least the pooled bound
SHARPNESS = 8.0            # of the score: per nat of cross-entropy between languages
REJECT_SPREADS = 8.0       # a bound is so many spreads above the median entropy,
REJECT_NATS = 1.0          # and so far above the entropy that 95 of 100 texts do not pass


# -- characters ---------------------------------------------------------------
@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """16-bit class of each code point: its lower-case letter, or a space."""
    out = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            code = ord(low) if len(low) == 1 else c
            out[c] = code if code < 0x10000 else 0xE000 + code % 6400
    return out


def _pieces(text: bytes) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE_BYTES)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield text[at:end].decode("utf-8", "replace")
        at = end


def _grams(texts: list[str], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``grams``, and the last three classes; ``before`` holds the three that
    the first text goes on from."""
    pad = "\x01" * (ORDER - 1)
    # lone surrogates cannot occur; the mark of a start is no letter, so no text holds it as one
    codes = np.frombuffer((pad + pad.join(t.replace("\x01", " ") for t in texts)).encode("utf-32-le"), "<u4")
    classes = _classes()[codes]
    classes[codes == START] = START
    which = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in texts])
    if before is not None:
        classes[:ORDER - 1] = before
    keep = np.ones(len(classes), bool)
    keep[1:] = ~((classes[1:] == SPACE) & ((classes[:-1] == SPACE) | (classes[:-1] == START)))
    classes, which = classes[keep].astype(np.uint64), which[keep]
    real = classes != START
    if before is not None:
        real[:ORDER - 1] = False
    letters = np.bincount(which[real & (classes != SPACE)], minlength=len(texts))
    key = classes.copy()
    for back in range(1, ORDER):
        key[back:] |= classes[:-back] << np.uint64(16 * back)
    return key[real], which[real], letters, classes[1 - ORDER:]


def gram_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``grams`` of all texts in parts of bounded size: a text beyond
    PIECE_BYTES goes on in each piece from the last characters of the one before."""
    short = [t if len(t) <= PIECE_BYTES else b"" for t in texts]
    if texts:
        yield _grams([t.decode("utf-8", "replace") for t in short])[:3]
    for i, t in enumerate(texts):
        if len(t) > PIECE_BYTES:
            before = None
            for piece in _pieces(t):
                key, which, letters, before = _grams([piece], before)
                yield key, which + i, np.where(np.arange(len(texts)) == i, letters.sum(), 0)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram ending at each character as four 16-bit classes in 64 bits, its
    text's number, letters per text)."""
    parts = list(gram_parts(texts))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)


def _hash(key: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit keys."""
    key = key.astype(np.uint64)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _suffix(key: np.ndarray, n: int) -> np.ndarray:
    """The last n characters."""
    return key & np.uint64((1 << (16 * n)) - 1)


# -- the models -----------------------------------------------------------------
@dataclass
class Part:
    """Log probabilities of n-grams (``sets``), or log back-off weights of
    n-grams as contexts: sorted hashes, and the cells from starts[i] to
    starts[i + 1] hold the value of the i-th in each language that has it."""

    n: int
    sets: bool
    hashes: np.ndarray
    starts: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(n: int, sets: bool, key: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Part:
        h = _hash(key)
        order = np.argsort(h, kind="stable")
        hashes, starts = np.unique(h[order], return_index=True)
        return Part(n, sets, hashes, np.append(starts, len(h)), lang[order].astype(np.int32),
                    value[order].astype(np.float32))

    def apply(self, out: np.ndarray, key: np.ndarray) -> None:
        """Raises ``out`` (n-grams x languages) from order n - 1 to n, or by the
        weights of the contexts of n characters."""
        if not len(self.hashes):
            return
        h = _hash(_suffix(key if self.sets else key >> np.uint64(16), self.n))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        row = np.flatnonzero(self.hashes[at] == h)
        first = self.starts[at[row]]
        sizes = self.starts[at[row] + 1] - first
        row = np.repeat(row, sizes)
        cell = np.arange(len(row)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        if self.sets:
            out[row, self.lang[cell]] = self.value[cell]
        else:
            out[row, self.lang[cell]] += self.value[cell]


@dataclass
class Models:
    """``packs`` are lists of parts, or broadcasts of such, by ascending order of
    the n-grams, log probabilities before back-off weights.  ``floor`` is each
    language's log probability of a character that it does not know."""

    languages: list[str]
    packs: list
    cells: int
    floor: np.ndarray
    bounds: np.ndarray

    def _parts(self) -> Iterator[Part]:
        for pack in self.packs:
            if not isinstance(pack, Broadcast):
                yield from pack
            elif self.cells <= HELD_CELLS:
                yield from pack.value
            else:  # not ``value``, which would keep what it loads
                yield from pack.load_from_path(pack._path)

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each 4-gram in each language."""
        out = np.repeat(self.floor[None].astype(np.float32), len(key), axis=0)
        for part in self._parts():
            part.apply(out, key)
        return out

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character of each text in each language, letters)."""
        total, n, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for key, which, some in gram_parts(texts):
            self._add(total, key, which)
            n += np.bincount(which, minlength=len(texts))
            letters += some
        return -total / np.maximum(n, 1)[:, None], letters

    def _add(self, total: np.ndarray, key: np.ndarray, which: np.ndarray) -> None:
        """Adds the log probabilities of n-grams to their texts' totals."""
        names, inverse = np.unique(key, return_inverse=True)
        room = max(1024, SCORE_CELLS // len(self.languages))
        for low in range(0, len(names), room):
            scores = self.score(names[low:low + room])
            here = np.flatnonzero((inverse >= low) & (inverse < low + room)) if len(names) > room else np.arange(len(key))
            for at in range(0, len(here), room):
                some = here[at:at + room]
                part, w = scores[inverse[some] - low], which[some]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(w)) + 1))
                np.add.at(total, w[cuts], np.add.reduceat(part, cuts, axis=0, dtype=np.float64))


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Interpolated model of one language from its 4-grams, by order: sorted
    n-grams, probability given the context, and the context's back-off weight."""
    levels: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(np.float64))]
    for n in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
        levels.append(tuple(np.unique(_suffix(levels[-1][0], n), return_counts=True)))
    levels.reverse()
    model: list[dict] = []
    for n, (k, c) in enumerate(levels, start=1):
        order = np.argsort(k)
        k, c = k[order], c[order].astype(np.float64)
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
        context = k >> np.uint64(16)
        names, inverse, types = np.unique(context, return_inverse=True, return_counts=True)
        totals = np.bincount(inverse, weights=c)
        weight = discount * types / totals
        if n == 1:
            lower = np.full(len(k), 1.0)  # scaled by the uniform floor below
            p = (c - discount) / totals[0] + weight[0] * lower / 65536
        else:
            below = model[-1]
            at = np.searchsorted(below["k"], _suffix(k, n - 1))
            p = (c - discount) / totals[inverse] + weight[inverse] * below["p"][at]
        model.append({"k": k, "p": p, "contexts": names, "weight": weight})
    return model


def _value(model: list[dict], key: np.ndarray, n: int) -> np.ndarray:
    """P(last character | the n - 1 before) in one language."""
    if n == 0:
        return np.full(len(key), 1 / 65536)
    level = model[n - 1]
    at = np.minimum(np.searchsorted(level["k"], key), len(level["k"]) - 1)
    out = level["p"][at].copy()
    miss = np.flatnonzero(level["k"][at] != key)
    if len(miss):
        part = key[miss]
        out[miss] = _weight(model, part >> np.uint64(16), n) * _value(model, _suffix(part, n - 1), n - 1)
    return out


def _weight(model: list[dict], context: np.ndarray, n: int) -> np.ndarray:
    """Back-off weight of a context of n - 1 characters: 1 if it is unknown."""
    level = model[n - 1]
    at = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
    return np.where(level["contexts"][at] == context, level["weight"][at], 1.0)


def merge_models(models: dict[str, list[dict]]) -> Models:
    """Models of counts that fit into memory, as ``fit`` makes them with Spark."""
    languages = sorted(models)
    parts = []
    for n in range(1, ORDER + 1):
        for sets, level, key, value in ((True, n, "k", "p"), (False, n + 1, "contexts", "weight")):
            if level <= ORDER:
                found = [models[x][level - 1] for x in languages]
                parts.append(Part.of(
                    n, sets, np.concatenate([m[key] for m in found]),
                    np.repeat(np.arange(len(found)), [len(m[key]) for m in found]),
                    np.log(np.concatenate([m[value] for m in found]))))
    none = np.zeros(1, np.uint64)
    floor = np.array([np.log(_weight(models[x], none, 1)[0] / 65536) for x in languages], np.float32)
    return Models(languages, [parts], sum(len(p.lang) for p in parts), floor, np.full(len(languages), np.inf))


# -- Spark --------------------------------------------------------------------------
def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 when divided by 3 (a null id: true)."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram long, n) over all texts of ``rows`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows_of(lang: str) -> pa.RecordBatch:
            k, n = summed(held.pop(lang))
            return pa.RecordBatch.from_arrays(
                [pa.DictionaryArray.from_arrays(np.zeros(len(k), np.int32), [lang]).dictionary_decode(),
                 pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for part in slices(batches, limit=SLICE_BYTES):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in set(langs):
                for key, _, _ in gram_parts([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    if not len(key):
                        continue
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(key, return_counts=True))
                    if len(parts) >= 8:
                        parts[:] = [summed(parts)]
                        if len(parts[0][0]) > FLUSH_TYPES:
                            yield rows_of(lang)
        for lang in list(held):
            yield rows_of(lang)

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _levels(counted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """By order: all n-grams (lang, gram, p) with their probability given the
    context, and all contexts (lang, gram, weight); ``kneser_ney`` in Spark."""
    counts = [counted.select("lang", "gram", F.col("n").cast("double").alias("c"))]
    for n in range(ORDER - 1, 0, -1):  # lower orders count distinct left neighbours
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1))
        counts.insert(0, cut_lineage(counts[0].groupBy("lang", suffix.alias("gram")).agg(
            F.count(F.lit(1)).cast("double").alias("c"))))
    out: list[tuple[DataFrame, DataFrame]] = []
    for n, c in enumerate(counts, start=1):
        once, twice = F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
        discount = F.when(once > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / (once + 2 * twice))))
        discounts = c.groupBy("lang").agg(F.coalesce(discount, F.lit(0.1)).alias("discount"))
        own = c.withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = cut_lineage(
            own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
            .join(F.broadcast(discounts), "lang")
            .withColumn("weight", F.col("discount") * F.col("types") / F.col("total")))
        rows = own.join(contexts, ["lang", "context"])
        share = (F.col("c") - F.col("discount")) / F.col("total")
        if n == 1:
            rows = rows.select("lang", "gram", (share + F.col("weight") / 65536).alias("p"))
        else:
            below = out[-1][0].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))).join(
                below, ["lang", "suffix"]).select("lang", "gram", (share + F.col("weight") * F.col("below")).alias("p"))
        out.append((cut_lineage(rows), contexts.select("lang", F.col("context").alias("gram"), "weight")))
    return out


def _collected(n: int, sets: bool, cells: DataFrame, value: str) -> Iterator[Part]:
    """All ``cells`` (lang, gram, value) in parts of about PART_CELLS."""
    parts = -(-cells.count() // PART_CELLS)
    for i in range(parts):
        some = cells.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == i) if parts > 1 else cells
        t = some.select("lang", "gram", F.log(value).cast("float").alias("value")).toArrow()
        yield Part.of(n, sets, t["gram"].to_numpy().view(np.uint64), t["lang"].to_numpy(), t["value"].to_numpy())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Models learned from all rows with a language that are not held out, with
    all their n-grams."""
    train = bounded(docs).where(column(lang_col).isNotNull() & ~held_out(id_col)).select(
        column(lang_col).cast("string").alias("lang"),
        F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    named = count_grams(train).persist()
    languages = sorted(r["lang"] for r in named.select("lang").distinct().collect())
    if not languages:
        named.unpersist()
        return None
    spark = docs.sparkSession
    numbers = spark.createDataFrame(list(enumerate(languages)), "number int, lang string")
    counted = cut_lineage(named.join(F.broadcast(numbers), "lang").select(F.col("number").alias("lang"), "gram", "n"))
    levels = _levels(counted)
    named.unpersist()
    floor = np.empty(len(languages), np.float32)
    for r in levels[0][1].select("lang", F.log(F.col("weight") / 65536).alias("floor")).collect():
        floor[r["lang"]] = r["floor"]
    merged = Models(languages, [], 0, floor, np.full(len(languages), np.inf))
    pack: list[Part] = []

    def send() -> None:
        if pack:
            merged.packs.append(spark.sparkContext.broadcast(pack[:]))
            pack.clear()

    for n in range(1, ORDER + 1):
        steps = [(True, levels[n - 1][0], "p")] + ([(False, levels[n][1], "weight")] if n < ORDER else [])
        for sets, cells, value in steps:
            for part in _collected(n, sets, cells, value):
                if sum(len(p.lang) for p in pack) + len(part.lang) > PART_CELLS:
                    send()
                pack.append(part)
                merged.cells += len(part.lang)
    send()
    merged.bounds = _calibrated(train, merged)
    return merged


def _calibrated(train: DataFrame, models: Models) -> np.ndarray:
    """Per language: an entropy that its own texts hardly reach.  Spread and
    high quantile leave out the worst texts, which may be mislabelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            entropy, letters = models.entropies(part.column("text").to_pylist())
            langs = part.column("lang").to_pylist()
            own = [float(entropy[i, models.languages.index(x)]) if letters[i] >= 20 and x in models.languages else None
                   for i, x in enumerate(langs)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(own, pa.float64())],
                                             names=["lang", "entropy"])

    found = train.mapInArrow(run, "lang string, entropy double").where("entropy is not null")
    quantiles = F.percentile_approx("entropy", [0.16, 0.5, 0.84, 0.95], 10_000).alias("q")
    # a null language: all together
    stats = {r["lang"]: r for r in found.rollup("lang").agg(quantiles, F.count(F.lit(1)).alias("texts")).collect()}

    def bound(q: list[float]) -> float:
        return max(q[1] + REJECT_SPREADS * (q[2] - q[0]) / 2, q[3] + REJECT_NATS)

    pooled = bound(stats[None]["q"]) if None in stats and stats[None]["q"] else np.inf
    out = np.full(len(models.languages), pooled)
    for i, lang in enumerate(models.languages):
        if lang in stats:
            own = bound(stats[lang]["q"])
            out[i] = own if stats[lang]["texts"] >= CALIBRATION_DOCS else max(own, pooled)
    return out


def decide(models: Models | None, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, entropy, rejected) of each text."""
    n = len(texts)
    if models is None:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    e, letters = models.entropies(texts)
    best = e.argmin(axis=1)
    entropy = e[np.arange(n), best]
    share = 1 / np.exp(-SHARPNESS * (e - entropy[:, None])).sum(axis=1)
    some = letters > 0
    lang = [models.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
    rejected = ~some | ((entropy > models.bounds[best]) & (letters >= 20))
    return lang, np.where(some, share, 0.0), np.where(some, entropy, 0.0), rejected


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score double, entropy double, rejected boolean) of
    every whole text.  ``score`` is the best language's share when languages
    are weighted by exp(-SHARPNESS * entropy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            lang, score, entropy, rejected = decide(models, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy),
                 pa.array(rejected)], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def accepted(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected; one narrow pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], at, SLICE_BYTES):
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(~decide(models, texts)[3]))

    return bounded(docs).mapInArrow(run, docs.schema)

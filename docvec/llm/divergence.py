"""Source divergence audit by three-dimensional cube partitioning.

Each language has a matrix of smoothed probabilities, sources x terms.  The
divergence of two sources is the sum over all terms of the absolute
difference of their rows.  The work is dealt into cells (group block, group
block, term block): a slice (group block, term block) of the matrix is packed
once and copied to the cells of its row and column, each cell computes the
partial divergences of its pairs of groups over its terms, and the partials
are added along the term axis.  A cell holds two slices of at most
GROUP_BLOCK x TERM_BLOCK numbers whatever the input.  As |a - b| = |b - a|,
only cells with first block <= second block exist.

All arithmetic is exact: counts are longs, probabilities are whole billionths
(1 + floor(10^9 (count + 5) / (N + 5 V))) from 38-digit decimals.

Rows: null text, language and source count as empty strings; repeated rows
and repeated ids count again; a text without terms still makes its group
occur; a language without kept terms has V = 0, pairs of value 0 and no term
rows; an empty table gives an empty result.  Only (text, lang, source) are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvec.llm.common import bounded, column
from docvec.operators.ranking import rank_within_group, top_k_per_group
from docvec.session import cut_lineage

GROUP_BLOCK = 32      # sources of a language in one block
TERM_BLOCK = 4096     # terms of a language in one block
HELD_TERMS = 1 << 18  # (group, term) counts that a task holds before it passes them on
CHUNK_BYTES = 1 << 20  # text cut into terms at once
UNIT = 1_000_000_000
PRIOR = 5

# Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased.
# In UTF-8 every byte of a non-ASCII character is 128 or more, so bytes can be cut as they are.
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_TO_TERMS = bytes(b if b >= 128 or b in _LETTERS else b + 32 if b + 32 in _LETTERS and b < 91 else 32 for b in range(256))


def term_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about CHUNK_BYTES of text."""
    at = 0
    while at < len(text):
        end = at + CHUNK_BYTES
        part = text[at:end].translate(_TO_TERMS)
        while end < len(text) and part[-1:] != b" ":  # go on to the end of the term
            more = text[end:end + CHUNK_BYTES].translate(_TO_TERMS)
            space = more.find(b" ") + 1 or len(more)
            part, end = part + more[:space], end + space
        yield part.split()
        at = end


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n long, docs long): occurrences of each term in
    each group and the group's documents that hold it.  A row with an empty
    term stands for the group itself.  Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, Counter] = {}
        inside: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, terms in total.items():
                names = list(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]] * len(names), pa.string()), pa.array([group[1]] * len(names), pa.string()),
                     pa.array([t.decode("utf-8", "replace") for t in names], pa.string()), pa.array(terms.values(), pa.int64()),
                     pa.array([inside[group][t] for t in names], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            total.clear()
            inside.clear()

        held = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for text, *key in zip(*columns, strict=True):
                group = tuple(key)
                if group not in total:
                    total[group], inside[group] = Counter({b"": 0}), Counter()
                    held += 1
                terms, kinds = total[group], set()
                before = len(terms)
                for chunk in term_chunks(text):
                    terms.update(chunk)
                    kinds.update(chunk)
                inside[group].update(kinds)
                held += len(terms) - before
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    def read(name: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit(""))

    rows = bounded(docs).select(read(text_col).cast("binary").alias("text"), read(lang_col).alias("lang"),
                                read(source_col).alias("source"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact."""
    top = f"cast({UNIT} as decimal(10,0)) * (cast({n} as decimal(20,0)) + {PRIOR})"
    return F.expr(f"1 + ({top}) div (cast({total} as decimal(20,0)) + {PRIOR} * cast({terms} as decimal(18,0)))")


def _packed(entries: DataFrame) -> DataFrame:
    """(lang, gb, tb, rows binary, cols binary, values binary): the counted
    cells of one slice in three arrays."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "gb": [key[1]], "tb": [key[2]],
                             "rows": [frame["r"].to_numpy("<i4").tobytes()], "cols": [frame["c"].to_numpy("<i4").tobytes()],
                             "values": [frame["p"].to_numpy("<i8").tobytes()]})

    placed = entries.select(
        "lang", F.expr(f"(g - 1) div {GROUP_BLOCK}").alias("gb"), F.expr(f"(t - 1) div {TERM_BLOCK}").alias("tb"),
        F.expr(f"cast((g - 1) % {GROUP_BLOCK} as int)").alias("r"), F.expr(f"cast((t - 1) % {TERM_BLOCK} as int)").alias("c"), "p")
    return placed.groupBy("lang", "gb", "tb").applyInPandas(
        run, "lang string, gb long, tb long, rows binary, cols binary, values binary")


def slices(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, gb, tb, width int, numbers array<long>, unseen array<long>,
    rows, cols, values): every slice of every language, also those without a
    counted cell.  ``unseen`` holds each group's probability of a term that
    it does not have.

    entries: (lang, g, t, p) with n > 0; groups: (lang, g, v, unseen)."""
    blocks = groups.where("v > 0").groupBy("lang", "v", F.expr(f"(g - 1) div {GROUP_BLOCK}").alias("gb")).agg(
        F.sort_array(F.collect_list(F.struct("g", "unseen"))).alias("members"))  # GROUP_BLOCK members at most
    wanted = blocks.select(
        "lang", "gb", F.explode(F.expr(f"sequence(0L, (v - 1) div {TERM_BLOCK})")).alias("tb"), "v",
        F.col("members.g").alias("numbers"), F.col("members.unseen").alias("unseen"))
    full = wanted.join(_packed(entries), ["lang", "gb", "tb"], "left")
    width = F.least(F.lit(TERM_BLOCK).cast("long"), F.col("v") - F.col("tb") * TERM_BLOCK).cast("int")
    return full.select("lang", "gb", "tb", width.alias("width"), "numbers", "unseen", "rows", "cols", "values")


def _matrix(width: int, unseen: np.ndarray, rows: bytes | None, cols: bytes | None, values: bytes | None) -> np.ndarray:
    m = np.repeat(np.asarray(unseen, np.int64)[:, None], width, axis=1)
    if rows is not None:
        m[np.frombuffer(rows, "<i4"), np.frombuffer(cols, "<i4")] = np.frombuffer(values, "<i8")
    return m


def cell_divergences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of each row of ``a`` and each row of ``b``."""
    return np.array([np.abs(b - row).sum(axis=1) for row in a], np.int64).reshape(len(a), len(b))


def pair_divergences(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value long) for g < h: the cube.  Each slice goes to the
    cells of its row and of its column; partials are added over term blocks."""
    last = groups.groupBy("lang").agg(F.expr(f"(max(g) - 1) div {GROUP_BLOCK}").alias("last"))
    sent = slices(entries, groups).join(last, "lang").withColumn("other", F.explode(F.expr("sequence(0L, last)")))
    sent = sent.withColumn("first", F.least("gb", "other")).withColumn("second", F.greatest("gb", "other")).drop("last", "other")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lang, first, second, _ = key
        side = {r.gb: (r.numbers, _matrix(r.width, r.unseen, r.rows, r.cols, r.values)) for r in frame.itertuples(index=False)}
        (g, a), (h, b) = side[first], side[second]
        value = cell_divergences(a, b)
        keep = np.asarray(g)[:, None] < np.asarray(h)[None, :]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"lang": lang, "g": np.asarray(g)[i], "h": np.asarray(h)[j], "value": value[i, j]})

    cells = sent.groupBy("lang", "first", "second", "tb").applyInPandas(run, "lang string, g long, h long, value long")
    return cells.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value long, rank int): for each (language,
    source) its divergence from every other source of the language (part
    ``pair``), and the ``top_terms`` terms that it uses most above the
    language's share (part ``term``)."""
    counts = cut_lineage(counted(docs, text_col, lang_col, source_col))
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = rank_within_group(terms.where(F.col("docs") >= min_docs).select("lang", "term", "in_lang"), "lang", ["term"], "t")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    numbered = rank_within_group(counts.where("term = ''").select("lang", "source"), "lang", ["source"], "g")
    cells = cut_lineage(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "t", "n", "in_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", "g", F.coalesce("total", F.lit(0).cast("long")).alias("total"),
        F.coalesce("v", F.lit(0).cast("long")).alias("v"), "lang_total")
    groups = cut_lineage(groups.withColumn("unseen", F.when(F.col("v") > 0, probability("0", "total", "v"))))
    entries = cells.join(groups.select("lang", "source", "g", "total", "v", "lang_total"), ["lang", "source"]).select(
        "lang", "source", "term", "g", "t", probability("n", "total", "v").alias("p"), probability("in_lang", "lang_total", "v").alias("q"))

    over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         (F.col("p") - F.col("q")).alias("value"))
    by = [F.desc("value"), F.asc("item")]
    over = top_k_per_group(over, ["lang", "source", "part"], top_terms, by, salt_col=F.xxhash64("item"))

    half = pair_divergences(entries.select("lang", "g", "t", "p"), groups)
    both = half.unionByName(half.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    empty = groups.where("v = 0").select("lang", "g")
    # a language without kept terms has no cells: its pairs are listed as they must be in the result, at 0
    both = both.unionByName(empty.join(empty.withColumnRenamed("g", "h"), "lang").where("g <> h").withColumn("value", F.lit(0).cast("long")))
    name = groups.select("lang", "g", "source")
    pairs = both.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*by)))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

"""Mixing sources to target weights.

The words of each source, its documents one after another, are packed into
blocks of a fixed length.  Each source's target says how many block slots it
fills.  The output is cut into shards, and the counts of slots per shard and
source are drawn from multinomials; they are drawn source by source, given the
source's total, so that no source misses its target or passes its limit by
chance.  A source's slots are numbered through its shards; slot g takes block
perm(g mod blocks) of pass g div blocks, where perm is a pseudorandom index
permutation (a Feistel network with cycle walking) of the source and the pass.
Blocks join slots by (source, block index).

So every block of a source is taken equally often, give or take one, and at
most ``cap`` times.  Everything is drawn by hashes and seeded generators:
reruns agree.  No stage works on one source as a whole: offsets are summed in
buckets of bounded size, shards and blocks are spread by hash.

Rows: a null text has size 0; texts without words belong to no block and are
never taken; a null source is a source of its own, last in order; repeated
rows and rows with a null id each count on their own; an empty table gives an
empty result.  Only (id, text, source) are read for the mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvec.llm.common import bounded, column
from docvec.operators.ranking import global_rank
from docvec.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3               # a source is taken this many times at most
BLOCK_WORDS = 64
SHARD_SLOTS = 4096    # block slots of a shard, on average
BUCKET_ROWS = 256     # rows, about, whose offsets one window sums
GROUP_SHARDS = 256    # shards among which one draw deals
FRAME_SLOTS = 1 << 17 # slots that a task makes at a time
TASK_SLOTS = 1 << 18  # slots that a task makes in all, about


# -- pseudorandom permutations and draws --------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of each index under the permutation of range(size) that belongs
    to its key: four Feistel rounds over the next even number of bits, walked
    along until back inside the range."""
    index, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    half = np.ones(len(size), np.uint64)
    for _ in range(31):
        small = (np.uint64(1) << (half * np.uint64(2))) < size
        if not small.any():
            break
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for round_ in range(1, 5):
            turn = _mixed(right ^ k ^ np.uint64(round_ * 0x9E3779B97F4A7C15 % 2**64))
            left, right = right, left ^ (turn & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _generator(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([p & (2**64 - 1) for p in parts])))


# -- the plan ---------------------------------------------------------------------------
@dataclass
class Mix:
    """rows: (doc_id, k1, k2, sid, start, size), one per document;
    sources: (sid, source, source_size, target, blocks, slots, key);
    slots: (sid, shard, slot, pass, block), one per block taken."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def row_keys(id_col: str, text_col: str, source_col: str) -> list:
    """Two hashes that tell rows with different (id, source, text) apart."""
    cols = [column(id_col), column(source_col), column(text_col)]
    shown = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return [F.xxhash64(*shown).alias("k1"), F.xxhash64(F.lit(1), *shown).alias("k2")]


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(source_col).cast("string").alias("source"),
                       size.alias("size"), *row_keys(id_col, text_col, source_col))


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (source_size, weight, ...) with target: weights share the
    sum of all sizes, no target passes ``cap`` times its source's size, and the
    excess is shared again by weight until none is above."""
    room = F.col("source_size") * cap
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:  # each step closes the sources that the level fills; at most one step a source
        full = F.lit(False) if level is None else F.col("weight") * level >= room
        sums = sources.agg(F.sum(F.when(full, room).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                           F.count(F.when(full, 1))).first()
        if sums[2] == held or not sums[1]:
            break
        held, level = sums[2], (total - sums[0]) / sums[1]
    return sources.withColumn("target", F.least(room, F.col("weight") * (level or 0.0)).cast("double"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = 1,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """What the mix takes of ``docs``; weights repeat over the sources in code
    point order, null last."""
    sized = cut_lineage(_sized(docs, id_col, text_col, source_col))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(per_source, [F.col("source").asc_nulls_last()], "sid")
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(weight, (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    slots = passes * blocks + F.least(blocks, F.round(rest / block_words).cast("long"))
    sources = cut_lineage(
        targets(ranked, cap).withColumn("blocks", blocks.cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long"))
        .withColumn("key", F.xxhash64(F.coalesce("source", F.lit("\x00")), F.lit(seed)))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
        .select("sid", "source", "source_size", "target", "blocks", "slots", "key", "buckets"))

    # offsets: running sums in (source, bucket), then over the buckets' totals
    rows = sized.join(sources.select("sid", "source", "buckets"), sized["source"].eqNullSafe(sources["source"]))
    rows = rows.drop("source").withColumn("bucket", F.pmod("k1", F.col("buckets"))).drop("buckets")
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select(
        "sid", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["sid", "bucket"])
    placed = cut_lineage(placed.select("doc_id", "k1", "k2", "sid", (F.col("base") + F.col("at")).alias("start"), "size"))
    return Mix(placed, sources, _slots(sources, seed), block_words)


def _slots(sources: DataFrame, seed: int) -> DataFrame:
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // SHARD_SLOTS))
    groups = -(-shards // GROUP_SHARDS)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = np.full(groups, GROUP_SHARDS)
        sizes[-1] = shards - GROUP_SHARDS * (groups - 1)
        for frame in frames:
            for r in frame.itertuples(index=False):
                n = _generator(seed, r.key, 0).multinomial(r.slots, sizes / shards)
                yield pd.DataFrame({"sid": r.sid, "blocks": r.blocks, "key": r.key, "group": np.arange(groups),
                                    "shards": sizes, "first": np.cumsum(n) - n, "n": n})

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                n = _generator(seed, r.key, 1, r.group).multinomial(r.n, np.full(r.shards, 1 / r.shards))
                ends = np.cumsum(n)
                for at in range(0, r.n, FRAME_SLOTS):
                    own = np.arange(at, min(r.n, at + FRAME_SLOTS))
                    shard = np.searchsorted(ends, own, side="right")
                    g = r.first + own
                    key = _mixed(np.uint64(r.key & (2**64 - 1)) ^ (g // r.blocks + 1).astype(np.uint64))
                    yield pd.DataFrame({
                        "sid": r.sid, "shard": r.group * GROUP_SHARDS + shard, "slot": own - (ends - n)[shard],
                        "pass": g // r.blocks, "block": permuted(g % r.blocks, np.full(len(g), r.blocks), key)})

    wanted = sources.where("slots > 0").select("sid", "blocks", "slots", "key")
    counts = wanted.mapInPandas(
        dealt, "sid long, blocks long, key long, group long, shards long, first long, n long").where("n > 0")
    # few short rows stand for very many slots: without a number, Spark would join them in one task by their size
    return counts.repartition(max(1, -(-total // TASK_SLOTS)), "sid", "group").mapInPandas(
        drawn, "sid long, shard long, slot long, pass long, block long")


def pieces(mix: Mix) -> DataFrame:
    """(doc_id, k1, k2, sid, start, size, block, low, high): the words
    [low, high) of each document that lie in each block of its source."""
    w = mix.block_words
    end = F.col("start") + F.col("size")
    span = F.sequence(F.floor(F.col("start") / w), F.floor((end - 1) / w))
    return mix.rows.where("size > 0").select("*", F.explode(span).alias("block")).select(
        "*", F.greatest(F.lit(0), F.col("block") * w - F.col("start")).alias("low"),
        F.least(F.col("size"), (F.col("block") + 1) * w - F.col("start")).alias("high"))


def taken(mix: Mix) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken long) per document."""
    times = mix.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    words = pieces(mix).select("sid", "start", "block", (F.col("high") - F.col("low")).alias("words"))
    sums = words.join(times, ["sid", "block"]).groupBy("sid", "start").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    # a start belongs to one document with words, and to empty ones before it
    some = mix.rows.where("size > 0").join(sums, ["sid", "start"], "left")
    none = mix.rows.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    rows = some.unionByName(none).join(mix.sources, "sid")
    return rows.select("doc_id", "size", "source", "source_size", "target",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(mix: Mix) -> DataFrame:
    """The output: (shard, slot, pass, block, sid, doc_id, k1, k2, start, low,
    high), each slot's block as the pieces of the documents in it."""
    # the slots are made after a small shuffle, whose size must not have them broadcast
    return pieces(mix).join(mix.slots.hint("merge"), ["sid", "block"]).select(
        "shard", "slot", "pass", "block", "sid", "doc_id", "k1", "k2", "start", "low", "high")


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents: a row of ``docs`` for each pass that takes words of
    it, with the text of the blocks taken in that pass, in the document's order.
    A full pass gives the whole text back.  Rows that agree in id, source and
    text are taken each on their own but share their other columns."""
    held = mixed(mix).groupBy("k1", "k2", "sid", "start", "pass").agg(
        F.sort_array(F.collect_list(F.struct("low", "high"))).alias("mix_spans"))
    # the documents' columns travel in a struct, where their names cannot clash
    texts = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"),
                        column(text_col).cast("string").alias("whole"), *row_keys(id_col, text_col, source_col))
    joined = texts.dropDuplicates(["k1", "k2"]).join(held.select("k1", "k2", "mix_spans"), ["k1", "k2"])

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([words_of(t, [(s["low"], s["high"]) for s in x]) for t, x in zip(text, spans, strict=True)])

    out = bounded(joined).select("row", cut("whole", "mix_spans").alias("mix_text"))
    kept = {text_col: F.col("mix_text")}
    if chars_col in docs.columns:
        kept[chars_col] = F.length("mix_text").cast(docs.schema[chars_col].dataType)
    return out.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def words_of(text: str, spans: list[tuple[int, int]]) -> str:
    """The words [low, high) of each span with the white space after them;
    what stands before the first word goes with it."""
    starts = [m.start() for m in re.finditer(WORD, text)]
    if starts:
        starts[0] = 0
    starts.append(len(text))
    return "".join([text[starts[a]:starts[b]] for a, b in spans])

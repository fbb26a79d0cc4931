"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into m = distance + 1 segments on a ring.  If
two fingerprints differ in at most ``distance`` bits, some segment i starts a
chain whose cumulative differences stay within the proportional budget at
every length: d_i + ... + d_(i+l-1) <= floor(l * distance / m) for l = 1..m.
So d_i = 0, and the next segment differs in at most one bit, which leaves one
of its two halves equal: candidates are found by an equality key made of
segment i and either half of segment i + 1, then pruned chain by chain before
the full Hamming check.

Equal fingerprints are grouped first, so copies cost one row.  A key shared by
more than ``block`` fingerprints is dealt out in pairs of chunks, so that no
task gets an unbounded group, and a group only sends on links to the smallest
member it reaches (a spanning forest), never all its pairs.

Rows: null text counts as empty (fingerprint zero, linked like any other);
repeated rows and ids each get their own result row; rows with a null id take
part, but a group's id is the smallest that is not null; an empty table gives
an empty result.  Only (id, text) are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import column, slices, text_rows
from docvec.llm.components import connected_components
from docvec.session import cut_lineage

BITS = 64
SEED = 42
PART_BYTES = 1 << 20  # a very long text is hashed in parts of about this size


def _word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (runs without ASCII white space), A-Z lower-cased,
    in lists from about PART_BYTES of text."""
    at = 0
    while at < len(text):
        end = at + PART_BYTES
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        words = text[at:end].lower().split()
        if words:
            yield words
        at = end


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit j is 1 if it is set in over half of the XXH64 values of the text's
    word shingles, repeats included."""
    counts, total, held = np.zeros(BITS, np.int64), 0, []

    def add(words: list[bytes], size: int) -> int:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:len(words) - size].tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[s:e - 1], SEED)
                  for s, e in zip(starts, ends[size - 1:].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in _word_parts(text):
        words = held + words
        if len(words) >= shingle:
            total += add(words, shingle)
            held = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            held = words
    if not total and held:
        total = add(held, len(held))
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the distance + 1 segments of the ring."""
    m = distance + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def key_masks(distance: int) -> list[tuple[int, int]]:
    """(segment, mask): the bits whose equality makes a candidate pair.  With
    distance 0 the ring is one segment, equal only for equal fingerprints."""
    ring = segments(distance)
    if distance == 0:
        return [(0, _mask(0, BITS))]
    out = []
    for i, (first, width) in enumerate(ring):
        f2, w2 = ring[(i + 1) % len(ring)]
        # the budget of the first two segments is floor(2 * distance / m) = 1 from distance 1 on
        for f, w in ((f2, w2 // 2), (f2 + w2 // 2, w2 - w2 // 2)):
            out.append((i, _mask(first, width) | _mask(f, w)))
    return out


def ring_matches(a: np.ndarray, b: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i], b[j] within ``distance`` bits whose chain
    from segment ``start`` keeps within its budget at every length."""
    ring, m = segments(distance), distance + 1
    x = a[:, None] ^ b[None, :]
    i, j = np.nonzero(np.ones(x.shape, bool)) if x.size < 64 else (None, None)
    mask = 0
    for length in range(1, m + 1):
        mask |= _mask(*ring[(start + length - 1) % m])
        budget = length * distance // m if length < m else distance
        if i is None:
            i, j = np.nonzero(np.bitwise_count(x & np.uint64(mask)) <= budget)
        else:
            keep = np.bitwise_count(x[i, j] & np.uint64(mask)) <= budget
            i, j = i[keep], j[keep]
        if not len(i):
            break
    return i, j


def _forest(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest one that it reaches."""
    i, j = ring_matches(fps, fps, start, distance)
    keep = i < j
    i, j = i[keep], j[keep]
    label = np.arange(len(fps))
    while len(i):
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (before == label).all():
            break
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(groups: DataFrame, distance: int, block: int = 512) -> DataFrame:
    """(u, v long) linking all distinct fingerprints of ``groups`` (fp) that
    are within ``distance`` bits, possibly through others."""
    masks = key_masks(distance)
    keyed = groups.select(
        F.col("fp"),
        F.posexplode(F.array(*[
            F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for _, m in masks])),
    ).select("fp", F.col("pos").alias("k"), F.col("col").alias("bits"))
    sizes = keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp"), chunks)
    dealt = (
        keyed.join(sizes, ["k", "bits"])
        .select("k", "bits", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
        .select("k", "bits", F.least("own", "other").alias("c0"), F.greatest("own", "other").alias("c1"), "fp")
    )
    starts = [s for s, _ in masks]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for frame in frames:
            if carry is not None:
                frame = pd.concat([carry, frame], ignore_index=True)
            keys = frame[["k", "bits", "c0", "c1"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            # the last group may go on in the next batch
            carry = frame.iloc[cuts[-1] if len(cuts) else 0:]
            yield from groups_of(frame, np.concatenate(([0], cuts)))
        if carry is not None and len(carry):
            yield from groups_of(carry, np.array([0, len(carry)]))

    def groups_of(frame: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        fps, ks = frame["fp"].to_numpy().view(np.uint64), frame["k"].to_numpy()
        us, vs = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                u, v = _forest(fps[a:b], starts[ks[a]], distance)
                if len(u):
                    us.append(u)
                    vs.append(v)
        if us:
            yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    spread = dealt.repartition("k", "bits", "c0", "c1").sortWithinPartitions("k", "bits", "c0", "c1", "fp")
    return spread.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): fingerprints link at ``distance`` or
    fewer differing bits; component_id is the smallest id reachable."""
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    nodes = connected_components(links(groups, distance)).withColumnRenamed("node", "fp")
    labelled = groups.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = labelled.join(least, "component").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id
    (of repeated rows with that id, one).  Rows without an id all stay."""
    found = near_duplicates(docs, shingle, distance, id_col, text_col)
    firsts = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.where(column(id_col).isNotNull()).join(firsts, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(column(id_col).isNull()))

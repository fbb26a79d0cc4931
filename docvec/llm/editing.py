"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j a text shows the character at its
position and moves on by a bit that depends on j and that character only.
After an edit two walks soon fall into step again, so the edit distance of two
texts maps to the Hamming distance of what their walks show.  A fingerprint
keeps a sample of the steps, one hexadecimal digit each ("0" past the end of
the text).  Samples are nested by rate: a text with a walk of S steps keeps
those whose rate is 2^-r, r the least that leaves about DIGITS of them, so
fingerprints of different lengths compare at the coarser rate.

`near_groups` bands sampled digits to find candidates, and verifies them by
the share of digits that agree.

Rows: a null text counts as empty (fingerprint "00"); equal texts have equal
fingerprints; rows are ordered by (id, text) with null ids first, so ties and
repeated rows have one order; an empty table gives an empty result.  Only
(id, text) are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvec.llm.common import slices, text_rows
from docvec.llm.components import connected_components
from docvec.session import cut_lineage

DIGITS = 256            # sampled steps of a fingerprint, at most about
STEPS_PER_CHAR = 3      # length of a walk
PERIOD = 1 << 12        # steps after which the walk's random bits repeat
PARTITION_CHARS = 3 << 20
BATCH_BYTES = 4 << 20   # text whose walks are made together
LEVELS = 40
DRAWS = 16              # draws for a position of a band


def _mixed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """(step mod PERIOD, character class): 1 if the walk moves on; class 0,
    the end of a text, never does."""
    bits = _mixed(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(0x51ED27)) >> np.uint64(63)
    out = bits.reshape(PERIOD, 256).astype(np.int64)
    out[:, 0] = 0
    return out


@lru_cache(maxsize=4)
def _levels(steps: int) -> np.ndarray:
    """Level of each step below ``steps`` (a power of two): a step is in the
    sample of rate 2^-r if its level is r or more."""
    h = _mixed(np.arange(steps, dtype=np.uint64) + np.uint64(0xA5A5_0001)) | (np.uint64(1) << np.uint64(LEVELS))
    low = h & (~h + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)).astype(np.int8)


def _power(n: int) -> int:
    return 1 << max(10, (max(1, n) - 1).bit_length())


def _rate(steps: int) -> int:
    return max(0, (max(1, -(-steps // DIGITS)) - 1).bit_length())


@lru_cache(maxsize=256)
def _sample(rate: int, power: int) -> np.ndarray:
    return np.flatnonzero(_levels(power) >= rate)


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes 1..255 of all texts, a 0 after each; lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    out = (_mixed(codes.astype(np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out[np.cumsum(lengths + 1) - 1] = 0
    return out, lengths


def fingerprints(texts: list[str]) -> list[str]:
    """Two hexadecimal digits of the rate, then one digit for each sampled step."""
    if not texts:
        return []
    text, lengths = _classes(texts)
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    steps = n * STEPS_PER_CHAR
    rates = np.array([_rate(int(s)) for s in steps])
    at = (np.cumsum(lengths + 1) - lengths - 1)[order]
    power = _power(int(steps[0]))
    levels, moves = _levels(power), _moves()
    counts = np.array([np.searchsorted(_sample(int(r), power), s) for r, s in zip(rates, steps, strict=True)])
    width = int(counts.max()) if len(counts) else 0
    seen = np.zeros((width, len(texts)), np.uint8)
    filled = np.zeros(len(texts), np.int64)
    first = np.searchsorted(-rates, -np.arange(LEVELS + 1), side="left")  # texts from here on have a rate of r or less
    active = int((n > 0).sum())
    columns = np.arange(len(texts))
    j = 0
    while active and j < steps[0]:
        # texts whose walk is over, or that show nothing more, drop out from the short end
        running = (steps[:active] > j) & (text[at[:active]] != 0)
        active = int(running.nonzero()[0][-1]) + 1 if running.any() else 0
        for step in range(j, min(j + 512, int(steps[0]))):
            shown = text.take(at[:active])
            level = levels[step]
            a = first[level]
            if a < active:
                live = steps[a:active] > step
                cols = columns[a:active] if live.all() else columns[a:active][live]
                digits = shown[cols]
                seen[filled[cols], cols] = np.where(digits > 0, (digits - 1) % 15 + 1, 0)
                filled[cols] += 1
            at[:active] += moves[step % PERIOD].take(shown)
        j += 512
    hexes = np.frombuffer(b"0123456789abcdef", np.uint8)[seen.T]
    out: list[str] = [""] * len(texts)
    for k, i in enumerate(order):
        out[i] = f"{rates[k]:02x}" + hexes[k, :counts[k]].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """Share of the steps sampled in both on which they agree, of those where
    either still shows a character; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    rate = max(int(a[:2], 16), int(b[:2], 16))
    rows = [_at_rate(a, rate), _at_rate(b, rate)]
    size = max(map(len, rows))
    x, y = (np.concatenate([r, np.full(size - len(r), 48, np.uint8)]) for r in rows)
    shown = (x != 48) | (y != 48)
    return float((x == y)[shown].sum() / shown.sum()) if shown.any() else float(rows[0].tobytes() == rows[1].tobytes())


# -- Spark ----------------------------------------------------------------------------
def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(texts), pa.string())],
                                             names=["doc_id", "fingerprint"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (part, tail, doc_id, text), dealt out in ranges of the id and sorted
    by (part, tail, doc_id, text), so that each document is followed by the next
    one; a part ends with copies (``tail``) of the document that starts the next
    part, the last part with the first of all.  The text is shuffled once."""
    rows = text_rows(docs, id_col, text_col)
    known = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least"),
                     F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    parts = max(1, -(-(known["bytes"] or 0) // PARTITION_CHARS))
    # parts - 1 ids of the table cut it into ranges: one number per range on the driver
    cuts = []
    if parts > 1 and known["least"] is not None:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, F.lit(10_000)).alias("q")).first()["q"]))
        cuts = [c for c in cuts if known["nulls"] or c > known["least"]]
    edges = np.array(cuts, np.int64)
    last = len(cuts)
    # the first of all: a null id if there is one
    first = None if known["nulls"] else known["least"]

    @F.pandas_udf("array<int>")
    def placed(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            if i is None or i != i:
                out.append([0, -last - 1])
                continue
            own = int(np.searchsorted(edges, int(i), side="right"))
            here = [own]
            if own and edges[own - 1] == int(i):
                here.append(-own)         # a copy ends part own - 1
            if first is not None and int(i) == first:
                here.append(-last - 1)    # a copy ends the last part
            out.append(here)
        return pd.Series(out)

    dealt = rows.select("doc_id", "text", F.explode(placed(F.col("doc_id").cast("decimal(20,0)"))).alias("place"))
    dealt = dealt.select(
        F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place")).alias("part"),
        (F.col("place") < 0).alias("tail"), "doc_id", "text")
    return dealt.repartition(last + 1, "part").sortWithinPartitions("part", "tail", "doc_id", "text"), last + 1


def compare_next(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every whole text and its edited one, in which the last floor(n /
    share) code points give way to the first as many (or all) of the next
    document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).  After the last document comes the first."""
    ordered, _ = with_next(docs, id_col, text_col)
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next document has come but for the last

        def made(rows: list[tuple]) -> pa.RecordBatch:
            whole = [r[3] for r in rows]
            pairs = [(a, b) for a, b in zip(range(len(rows)), range(1, len(rows)))
                     if rows[a][0] == rows[b][0] and not rows[a][1]]
            edited = []
            for a, b in pairs:
                cut = len(whole[a]) // share
                edited.append(whole[a][:len(whole[a]) - cut] + whole[b][:cut])
            prints = fingerprints(whole + edited)
            own, changed = prints[:len(rows)], prints[len(rows):]
            cols = [
                pa.array([rows[a][2] for a, _ in pairs], pa.int64()),
                pa.array([len(whole[a]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array([own[a] for a, _ in pairs], pa.string()), pa.array(changed, pa.string()),
                pa.array([likeness(own[a], e) for (a, _), e in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(own[a], own[b]) for a, b in pairs], pa.float64())]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

        for part in slices(batches, limit=BATCH_BYTES):
            cols = [part.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")]
            held += [(p, t, i, x.decode("utf-8", "replace")) for p, t, i, x in zip(*cols, strict=True)]
            yield made(held)
            held = held[-1:]

    return ordered.mapInArrow(run, schema)


def _at_rate(print_: str, rate: int) -> np.ndarray:
    """Digits of a fingerprint in the sample of this rate or its own, if coarser."""
    own, digits = int(print_[:2], 16), np.frombuffer(print_[2:].encode(), np.uint8)
    if own < rate:  # nested: keep the digits of the coarser sample
        power = _power(min(STEPS_PER_CHAR << 30, (len(digits) + 64) << (own + 2)))
        digits = digits[_levels(power)[_sample(own, power)[:len(digits)]] >= rate]
    return digits


def alike_forest(prints: list[str], threshold: float, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join all fingerprints whose ``likeness`` is at least
    ``threshold``, possibly through others; every pair is compared, or with
    ``asked`` every pair of which that marks one."""
    rates = np.array([int(x[:2], 16) for x in prints])
    asked = np.ones(len(prints), bool) if asked is None else asked
    label = np.arange(len(prints))
    for rate in np.unique(rates).tolist():  # pairs whose coarser rate is this
        members = np.flatnonzero(rates <= rate)
        rows = [_at_rate(prints[m], rate) for m in members]
        digits = np.full((len(rows), max(map(len, rows))), 48, np.uint8)
        for row, d in zip(digits, rows, strict=True):
            row[:len(d)] = d
        wanted = np.flatnonzero(asked[members])
        for a, i in enumerate(members.tolist()):
            if rates[i] != rate:
                continue
            to = slice(None) if asked[i] else wanted
            others, against = members[to], digits[to]
            shown = (against != 48) | (digits[a] != 48)
            n, same = shown.sum(axis=1), ((against == digits[a]) & shown).sum(axis=1)
            near = (n > 0) & (same / np.maximum(n, 1) >= threshold)
            for b in np.flatnonzero(n == 0).tolist():
                near[b] = likeness(prints[i], prints[others[b]]) >= threshold
            joined = np.unique(label[np.append(others[near], i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return linked, label[linked]


def near_groups(prints: DataFrame, threshold: float = 0.8, bands: int = 16, width: int = 6,
                block: int = 512) -> DataFrame:
    """(doc_id, group): documents whose fingerprints (doc_id, fingerprint) agree
    in at least ``threshold`` of their digits, possibly through others; ``group``
    is the smallest hash of a fingerprint in it.

    Candidates agree in one of ``bands`` samples of ``width`` digits; only
    hashes of bands are dealt out, fingerprints join those that share one.  Equal
    fingerprints are grouped first.  All pairs that share a band are verified,
    but for pairs that links already join: a band's members meet in chunks of
    about ``block``, dealt anew in each band, and the links are followed.  Where
    a band's chunks are not in one group then, each member outside of its
    largest group meets all others, in pairs of chunks."""
    prints = cut_lineage(prints.select("doc_id", "fingerprint"))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies")).select(
        "fingerprint", F.xxhash64("fingerprint").alias("node")))

    @F.pandas_udf("array<long>")
    def keys(values: pd.Series) -> pd.Series:
        return pd.Series([band_keys(v, bands, width) for v in values])

    banded = cut_lineage(distinct.select("node", F.explode(keys("fingerprint")).alias("band")))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(banded.join(sizes, "band"))
    chunks = F.ceil(F.col("n") / block)
    first = met.select("band", F.pmod(F.xxhash64("node", "band"), chunks).alias("c0"), F.lit(0).cast("long").alias("c1"),
                       "node", F.lit(True).alias("asked"))
    edges = cut_lineage(_links(first, distinct, threshold))
    wide = met.where(F.col("n") > block)
    if not wide.isEmpty():
        groups = connected_components(edges)
        wide = cut_lineage(wide.join(groups, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")))
        counts = wide.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        open_ = cut_lineage(wide.join(largest.where("parts > 1"), "band").select(
            "band", "node", (F.col("component") != F.col("top.component")).alias("asked"), "n", (F.col("n") - F.col("top.n")).alias("outside")))
        # rows of a cell: some of the members outside (asked) and a chunk of all
        rows, columns = F.ceil(F.col("outside") / block), F.ceil(F.col("n") / block)
        every = open_.select("band", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("c0"),
                             F.pmod(F.xxhash64("node"), columns).alias("c1"), "node", F.lit(False).alias("asked"))
        outside = open_.where("asked").select("band", F.pmod(F.xxhash64("node"), rows).alias("c0"),
                                              F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)).alias("c1"), "node", "asked")
        cells = every.unionByName(outside).groupBy("band", "c0", "c1", "node").agg(F.max("asked").alias("asked"))
        edges = edges.unionByName(_links(cells, distinct, threshold))
    nodes = connected_components(edges)
    grouped = distinct.join(nodes, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("group"))
    return prints.join(grouped, "fingerprint").select("doc_id", "group")


def _links(cells: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """(u, v): a spanning forest of the links inside each cell (band, c0, c1)
    of nodes; a cell's links are of pairs with an ``asked`` node."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for frame in frames:
            if carry is not None:
                frame = pd.concat([carry, frame], ignore_index=True)
            keys = frame[["band", "c0", "c1"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            # the last group may go on in the next batch
            carry = frame.iloc[cuts[-1]:]
            yield joined(frame, cuts)
        if carry is not None and len(carry):
            yield joined(carry, [0, len(carry)])

    def joined(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        nodes, asked, prints = frame["node"].to_numpy(), frame["asked"].to_numpy(bool), frame["fingerprint"].tolist()
        left, right = [], []
        for a, b in zip(cuts, cuts[1:]):
            if b - a == 2:  # most cells are of two
                if (asked[a] or asked[a + 1]) and likeness(prints[a], prints[a + 1]) >= threshold:
                    left.append(nodes[a:a + 1])
                    right.append(nodes[a + 1:b])
            elif b - a > 2:
                u, v = alike_forest(prints[a:b], threshold, asked[a:b])
                left.append(nodes[a:b][u])
                right.append(nodes[a:b][v])
        return pd.DataFrame({"u": np.concatenate([*left, nodes[:0]]), "v": np.concatenate([*right, nodes[:0]])}).drop_duplicates()

    spread = cells.join(distinct, "node").select("band", "c0", "c1", "node", "asked", "fingerprint")
    spread = spread.repartition("band", "c0", "c1").sortWithinPartitions("band", "c0", "c1", "node")
    return spread.mapInPandas(run, "u long, v long")


@lru_cache(maxsize=16)
def _draws(positions: int, digits: int) -> np.ndarray:
    """(positions, DRAWS): shared draws below ``digits``."""
    draws = _mixed(np.arange(positions * DRAWS, dtype=np.uint64) + np.uint64(7)) % np.uint64(digits)
    return draws.astype(np.int64).reshape(positions, DRAWS)


def band_keys(print_: str, bands: int, width: int) -> list[int]:
    """Hashes of ``bands`` samples of digits, at this rate and the next coarser
    one, where a text a little longer has its own."""
    rate = int(print_[:2], 16)
    digits = np.frombuffer(print_[2:].encode(), np.uint8)
    out = []
    for r in (rate, rate + 1):
        if r > rate:
            power = _power((len(digits) + 64) << (rate + 2))
            digits = digits[_levels(power)[_sample(rate, power)[:len(digits)]] >= r]
        shown = np.flatnonzero(digits != 48)
        ends = int(shown[-1]) + 1 if len(shown) else 0
        picked = [b""] * bands
        if ends:  # each position is the first of a shared row of draws over all digits that lies in this text
            draws = _draws(bands * width, DIGITS >> (r - rate))
            inside = draws < ends
            at = np.where(inside.any(axis=1), draws[np.arange(len(draws)), inside.argmax(axis=1)], draws[:, 0] % ends)
            text = digits[at].tobytes()
            picked = [text[b:b + width] for b in range(0, len(text), width)]
        out += [int.from_bytes(hashlib.blake2b(b"%d:%d:" % (r, b) + x, digest_size=8).digest(), "little", signed=True)
                for b, x in enumerate(picked)]
    return sorted(set(out))

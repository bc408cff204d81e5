"""SimHash near-duplicates by segment bit counts.

Fingerprints are the majority bits of the 64-bit hashes of all word shingles. To find all pairs
within ``max_bits`` without comparing all pairs, a fingerprint is cut into 2-bit segments and each
segment is mapped to its number of set bits. The Manhattan distance of these count vectors is a
lower bound of the bit distance. Eight groups of four segments give a grid of eight coordinates;
two vectors within Manhattan distance ``max_bits`` agree on at least ``8 - max_bits`` coordinates,
so the range join is an equi join on every choice of that many coordinates.

Groups of near copies would still meet in full in a cell, so the join has two steps. First
each cell member is checked against the cell's smallest fingerprint only, which links nearly all
of a dense group in linear work. Then members of one cell that are not yet in one component are
compared with each other, which finds every link that is still missing between components. The choices
are dealt out to passes, so that only a part of the cells is on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import bits_apart, components, cut, discard, lower_ascii, pieces, sent, small_batches, stored, string_offsets, word_bounds

SEED = 42
GROUPS, SEGMENT = 8, 2


def text_fingerprints(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each text (rows of a byte array): unsigned 64-bit, zero for a text without words."""
    data = lower_ascii(data)
    start, end, before = word_bounds(data, off)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(start):
        return out
    # All words with one space after each: a shingle is then one slice.
    size = end - start
    at = np.cumsum(size + 1) - size - 1
    flat = np.full(int(size.sum() + len(size)), 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    letters = data[np.cumsum(inside[:-1]) > 0]
    flat[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    words = np.diff(before)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    head = before[:-1][row] + np.arange(len(row)) - base[row]
    tail = head + np.minimum(words, shingle)[row] - 1
    buf, h = flat.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (h(buf[a:b], SEED) for a, b in zip(at[head].tolist(), (at + size)[tail].tolist(), strict=True)), np.uint64, len(row)
    )
    full = np.flatnonzero(count)
    step = 1 << 16
    sums = np.zeros((len(count), 64), np.int64)
    for a in range(0, len(row), step):  # bounded even for one very long text
        part = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r = row[a : a + step]
        new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        np.add.at(sums, r[new], np.add.reduceat(part, new, axis=0, dtype=np.int64))
    bits = sums[full] * 2 > count[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null text: no words, so zero.
    A text with fewer words than ``shingle`` has one shingle of all its words. Repeated rows and null ids
    give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = text_fingerprints(*string_offsets(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


#: Choices of grid coordinates are joined in so many passes: each pass shuffles its share of the cells, keeps only links, and its
#: shuffle files go before the next one.
PASSES = 3


def _choices(max_bits: int) -> list[list[tuple[int, tuple[int, ...]]]]:
    """The choices of ``GROUPS - max_bits`` grid coordinates, with their numbers, dealt out to passes."""
    if not 0 <= max_bits < GROUPS:
        raise ValueError(f"max_bits must be from 0 to {GROUPS - 1}")
    every = list(enumerate(combinations(range(GROUPS), GROUPS - max_bits)))
    return [x for x in (every[k::PASSES] for k in range(PASSES)) if x]


def _cells(fps: DataFrame, choices: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """The rows of ``fps`` (``fp`` and others) with ``cell``: one row per choice."""
    span = 64 // GROUPS
    levels = (SEGMENT + 1) ** (span // SEGMENT)

    def coordinate(g: int):
        total = F.lit(0)
        for s in range(span // SEGMENT):
            seg = F.bit_count(F.shiftrightunsigned("fp", g * span + s * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)))
            total = total + seg * (SEGMENT + 1) ** s
        return total.cast("long")

    grid = fps.select("*", *[coordinate(g).alias(f"g{g}") for g in range(GROUPS)])
    keys = []
    for i, chosen in choices:
        cell = F.lit(i).cast("long")
        for g in chosen:
            cell = F.xxhash64(cell, F.col(f"g{g}")) if len(chosen) > 8 else cell * levels + F.col(f"g{g}")
        keys.append(cell)
    return grid.select(F.explode(F.array(*keys)).alias("cell"), *fps.columns)


def near_duplicates(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): ``component_id`` is the smallest doc_id that
    links of at most ``max_bits`` differing bits reach. Equal fingerprints are linked, zero included.
    Rows with a null id get the component of their fingerprint (null if it has no other id)."""
    spark = fps.sparkSession
    fps = cut(fps.select("doc_id", "fp"))
    own = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small table that the cells make large
    single = cut(own.select("fp").repartition(wide, "fp"))
    links, shared = [], []
    for choices in _choices(max_bits):
        cells = _cells(single, choices)
        # A fingerprint is in a cell once, so a cell of two is settled by its two ends; larger ones get their members.
        ends = stored(
            cells.groupBy("cell").agg(F.min("fp").alias("pivot"), F.max("fp").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        )
        near_ends = bits_apart(F.col("pivot"), F.col("top")) <= max_bits
        pairs = ends.where((F.col("n") == 2) & near_ends).select(F.col("pivot").alias("a"), F.col("top").alias("b"))
        larger = sent(ends.where("n > 2").select("cell", "pivot"))
        star = cells.join(larger, "cell").where((F.col("fp") != F.col("pivot")) & (bits_apart(F.col("fp"), F.col("pivot")) <= max_bits))
        links.append(stored(pairs.unionByName(star.select(F.col("pivot").alias("a"), F.col("fp").alias("b"))).distinct()))
        shared.append(ends)
    by_star = cut(components(_all(links)))
    discard(*links)
    # Members of one cell that are in different components yet, against each other.
    labelled = cut(
        single.join(by_star, single.fp == by_star.node, "left").select("fp", F.coalesce("label", "fp").alias("label")).repartition(wide, "fp")
    )
    across = []
    for choices, ends in zip(_choices(max_bits), shared, strict=True):
        placed = stored(_cells(labelled, choices).join(sent(ends.where("n > 2").select("cell")), "cell"))
        mixed = placed.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("cell")
        both = stored(placed.join(mixed, "cell"))
        a = both.select("cell", F.col("fp").alias("fa"), F.col("label").alias("a"))
        b = both.select("cell", F.col("fp").alias("fb"), F.col("label").alias("b"))
        near = (F.col("a") < F.col("b")) & (bits_apart(F.col("fa"), F.col("fb")) <= max_bits)
        across.append(stored(a.join(b, "cell").where(near).select("a", "b").distinct()))
        discard(placed, both, ends)
    merged = cut(components(_all(across)))
    discard(*across)
    labels = (
        own.join(by_star, own.fp == by_star.node, "left")
        .select("fp", "first", F.coalesce("label", "fp").alias("label"))
        .join(merged.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left")
        .select("fp", "first", F.coalesce("final", "label").alias("label"))
    )
    smallest = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = labels.join(smallest, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def simhash_near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; ``fingerprint`` as 16 hex digits."""
    found = near_duplicates(fingerprints(docs, shingle), max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

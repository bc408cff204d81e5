"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: position t is a trigger if its 16-byte hash is the
least of some window of ``window`` positions. The trigger of the window that a string begins with
is its anchor. Equal strings have their anchor at the same offset, so it is enough to compare strings
with equal anchors' contexts, and the phrases (the dictionary) are far fewer than the positions.

What the suffix arrays of dictionary and parse would order is ranked here by equality classes only, as
the question is which strings of ``length`` bytes occur twice, not their order: first the part that
all strings of an anchor share, then the whole stretch of strings of an anchor, then stretches of
``BLOCK`` strings, then single strings. Each step counts hash keys in Spark and passes on only what
it cannot decide yet: in long copies that is a handful of phrases at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import Rolling, but_for, discard, given_id, id_or_text, only, pieces, small_batches, stored, string_offsets, window_min

GRAM, BLOCK = 16, 16
_PLACE = np.uint64((1 << 28) - 1)


def anchored(data: np.ndarray, off: np.ndarray, roll: Rolling, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Stretches of string starts with one anchor: (row, anchor, first start, last start), as bytes of ``data``."""
    starts = np.maximum(np.diff(off) - length + 1, 0)
    total = int(starts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(data) - GRAM + 1)
    # Hash above, position below: the least is the leftmost of equal hashes.
    key = (roll.of(at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
    least = (window_min(key, window) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), starts)
    p = off[:-1][row] + np.arange(total) - (np.cumsum(starts) - starts)[row]
    a = least[p]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    return row[new], a[new], p[new], p[np.r_[new[1:], total] - 1]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tag, text): a row is known by its id and a hash of its text; rows equal in both are repeated rows."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(docs).select(id_or_text(F.col("doc_id"), t).alias("doc"), F.shiftright(F.xxhash64(t), 32).cast("int").alias("tag"), t.alias("text"))


def _classes(df: DataFrame, core: list[str], same: list[str], own: list[str], weight: str = "1") -> DataFrame:
    """Equality classes of rows: per value of ``core`` and ``same`` the weight ``n`` and one member's ``own`` columns.
    Counts are combined before the shuffle, so a class of any size is a few rows."""
    return df.groupBy(*core, *same).agg(F.sum(F.expr(weight)).alias("n"), F.min(F.struct(*own)).alias("member"))


def _open(classes: DataFrame, core: list[str]) -> DataFrame:
    """The classes of all cores that have a class of one string set: the undecided ones, and beside them the
    classes that may hold their twins."""
    return classes.join(classes.where("n = 1").select(*core).distinct(), core, "left_semi")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: ``place`` of a row: anchor, and the distances of the first and the last start to it.
_FIELD = 1 << 9


def _place(anchor, lo, hi):
    return (anchor * _FIELD + (anchor - lo)) * _FIELD + (anchor - hi)


def _starts() -> list[F.Column]:
    """(lo, hi) of a ``place``."""
    anchor = F.floor(F.col("place") / (_FIELD * _FIELD))
    return [(anchor - F.floor(F.col("place") / _FIELD) % _FIELD).alias("lo"), (anchor - F.col("place") % _FIELD).alias("hi")]


def _phrases(docs: DataFrame, length: int, window: int) -> DataFrame:
    """Per anchor: (doc, tag, place, core, h): ``core`` the hash of the bytes that all strings of the anchor share, ``h``
    of all bytes of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = string_offsets(part.column(2))
                if len(data) < length:
                    continue
                one, two = Rolling(data), Rolling(data, 1)
                row, a, lo, hi = anchored(data, off, one, length, window)
                base, take = off[:-1][row], pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take), pa.array(_place(a - base, lo - base, hi - base)),
                        _signed(one.of(a, a + length - window + 1)), _signed(two.of(lo, hi + length)),
                    ],
                    ["doc", "tag", "place", "core", "h"],
                )

    return docs.mapInArrow(run, "doc long, tag int, place long, core long, h long")


def _cores(docs: DataFrame, length: int, window: int) -> DataFrame:
    """The column ``core`` of ``_phrases`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = string_offsets(part.column(0))
                if len(data) >= length:
                    one = Rolling(data)
                    a = anchored(data, off, one, length, window)[1]
                    yield pa.RecordBatch.from_arrays([_signed(one.of(a, a + length - window + 1))], ["core"])

    return docs.select("text").mapInArrow(run, "core long")


def _with_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, tag, text, at): the texts of places (doc, tag, place, n), with the list of theirs."""
    at = places.groupBy("doc", "tag").agg(F.collect_set(F.struct("place", "n")).alias("at"))
    texts = only(docs, places.select("doc", "tag").distinct(), ["doc", "tag"])
    return texts.join(at, ["doc", "tag"]).select("doc", "tag", "text", "at")


def _listed(part: pa.RecordBatch, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all listed places of a batch: row, anchor, first start, last start, n, first byte of the row's text."""
    at = part.column(3)
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    x = at.flatten()
    place, n = x.field("place").to_numpy(), x.field("n").to_numpy()
    anchor, far, near = place // (_FIELD * _FIELD), place // _FIELD % _FIELD, place % _FIELD
    return row, anchor, anchor - far, anchor - near, n, off[:-1][row]


def _split(row, first, n):
    """Numbers first, first + 1, ... first + n - 1 of each row: (index of the row, number)."""
    r = np.repeat(np.arange(len(row)), n)
    return r, first[r] + np.arange(len(r)) - (np.cumsum(n) - n)[r]


def _blocks(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Per place and ``BLOCK`` distances to its anchor: (doc, tag, place, n, block, c1, c2, h1, h2), c: hashes of the
    bytes that all strings of the whole block share, h: of all bytes of the block's strings here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = string_offsets(part.column(2))
                one, two = Rolling(data), Rolling(data, 1)
                row, a, lo, hi, n, base = _listed(part, off)
                first, last = (a - hi) // BLOCK, (a - lo) // BLOCK  # a string starts a - p before its anchor
                r, b = _split(row, first, last - first + 1)
                lo, hi, a = np.maximum(lo[r], a[r] - b * BLOCK - BLOCK + 1), np.minimum(hi[r], a[r] - b * BLOCK), a[r]
                c_lo = a - b * BLOCK + base[r]
                c_hi, h_lo, h_hi = c_lo - BLOCK + 1 + length, lo + base[r], hi + length + base[r]
                take = pa.array(row[r])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take), pa.array(_place(a, lo, hi)), pa.array(n[r]), pa.array(b),
                        _signed(one.of(c_lo, c_hi)), _signed(two.of(c_lo, c_hi)), _signed(one.of(h_lo, h_hi)), _signed(two.of(h_lo, h_hi)),
                    ],
                    ["doc", "tag", "place", "n", "block", "c1", "c2", "h1", "h2"],
                )

    return _with_texts(docs, places).mapInArrow(run, "doc long, tag int, place long, n long, block long, c1 long, c2 long, h1 long, h2 long")


def _strings(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Per string of the places: (doc, tag, lo, back, n, h1, h2), ``back`` its distance to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = string_offsets(part.column(2))
                one, two = Rolling(data), Rolling(data, 1)
                row, a, lo, hi, n, base = _listed(part, off)
                r, p = _split(row, lo, hi - lo + 1)
                x, take = p + base[r], pa.array(row[r])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(p), pa.array(a[r] - p), pa.array(n[r]), _signed(one.of(x, x + length)), _signed(two.of(x, x + length))],
                    ["doc", "tag", "lo", "back", "n", "h1", "h2"],
                )

    return _with_texts(docs, places).mapInArrow(run, "doc long, tag int, lo long, back long, n long, h1 long, h2 long")


def repeated_starts(docs: DataFrame, length: int = 400, window: int = 128) -> DataFrame:
    """(doc, tag, lo, hi): stretches of starts of ``length``-byte strings that also start elsewhere, for
    rows (doc, tag, text). Strings never cross rows."""
    if not BLOCK < window <= min(length - GRAM, _FIELD):
        raise ValueError("window must be larger than a block, and fit a string with its last gram")
    reach = (F.col("place") % (_FIELD * _FIELD)).alias("reach")
    own, whole, part = ["doc", "tag", "place"], ["h1", "h2", "reach"], ["block", "c1", "c2"]

    # The cores alone first: the join then has plain shuffles on both sides, of which hot cores are split.
    cores = stored(_cores(docs, length, window).groupBy("core").count().where("count > 1").select("core"))
    shared = stored(_phrases(docs, length, window).join(cores, "core", "left_semi")).withColumn("reach", reach)
    discard(cores)
    classes = stored(_classes(shared, ["core"], ["h", "reach"], own))
    done = shared.join(classes.where("n > 1").select("core", "h", "reach"), ["core", "h", "reach"], "left_semi").select("doc", "tag", *_starts())

    undecided = _open(classes, ["core"]).select("member.*", "n")
    blocks = stored(_blocks(docs, undecided, length)).withColumn("reach", reach)
    of_blocks = stored(_classes(blocks, part, whole, own, "n"))
    again = blocks.where("n = 1").join(of_blocks.where("n > 1").select(*part, *whole), [*part, *whole], "left_semi")
    done = done.unionByName(again.select("doc", "tag", *_starts()))

    strings = stored(_strings(docs, _open(of_blocks, part).select("member.*", "n"), length))
    twice = strings.groupBy("back", "h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").drop("times")
    alone = strings.where("n = 1").join(twice, ["back", "h1", "h2"], "left_semi")
    return done.unionByName(alone.select("doc", "tag", "lo", F.col("lo").alias("hi")))


def remove_repeats(docs: DataFrame, length: int = 400, window: int = 128) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: each byte of the UTF-8 text that a ``length``-byte
    string covers which also starts elsewhere is removed, judged on the input. ``spans``: the removed runs
    (first, end) in order; ``kept``: the other bytes. Null text: empty. Repeated rows are copies of each other."""
    rows = _keyed(docs)
    starts = repeated_starts(rows, length, window)
    spans = stored(starts.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, "text"):
                sizes, removed, runs, kept = [], [], [], []
                for text, at in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, merged = text.encode("utf-8"), []
                    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in at or ()):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    sizes.append(len(raw))
                    removed.append(sum(b - a for a, b in merged))
                    runs.append([{"first": a, "end": b} for a, b in merged])
                    edges = [0, *(x for m in merged for x in m), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    ids = spans.select("doc", "tag")
    whole = but_for(rows, ids, ["doc", "tag"]).withColumn("at", F.lit(None).cast(spans.schema["at"].dataType))
    joined = only(rows, ids, ["doc", "tag"]).join(spans, ["doc", "tag"]).select("doc", "tag", "text", "at").unionByName(whole)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, end: long>>, kept binary"
    return joined.select(given_id(F.col("doc")).alias("doc_id"), "text", "at").mapInArrow(run, schema)


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

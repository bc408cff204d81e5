"""Shared helpers: text columns as byte arrays, word boundaries, hashing, components of a link table."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.sesion import asegurar_checkpoint

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (fixed by the query contracts).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Texts are processed in pieces of about so many bytes, so the arrays of a piece stay small.
PIECE_BYTES = 1 << 19


def per_worker(name: str, build):
    """``build()`` once per Python worker process; later tasks of the process reuse the value."""
    kept = sys.modules.setdefault("_matricula_llm_kept", types.ModuleType("_matricula_llm_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, build())
    return getattr(kept, name)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``limit`` text bytes (a longer single text is one slice)."""
    n = batch.num_rows
    if not n:
        return
    size = np.diff(string_offsets(batch.column(batch.schema.get_field_index(text)))[1])
    part = np.cumsum(size) // max(1, limit)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True):
        yield batch.slice(int(a), int(b - a))


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands at most 1,000 rows, and a row more than 4 MB, at once to Python, so
    that texts of both sides of the pipe stay small beside the heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def string_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    if pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    else:
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64, col.offset + len(col) + 1)[col.offset :] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _byte_set(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


BLANK = _byte_set(SPACES)
#: Everything in ASCII but letters and digits; bytes of other characters count as letters.
NO_LETTER = _byte_set(b for b in range(128) if not chr(b).isalnum())


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_bounds(data: np.ndarray, off: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it (n + 1 entries).
    ``apart``: the bytes that separate words. A word never crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~apart[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]  # a row's first byte opens, the byte before it closes
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


#: Odd multiplier of the rolling polynomial hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n. Those for pieces of the usual size are kept in the worker."""
    kept = per_worker("powers", dict)
    usual = PIECE_BYTES * 5 // 4
    if n > usual or base not in kept:
        out = np.full(max(n, usual) + 1, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.cumprod(out, dtype=np.uint64)
        if n > usual:
            return out[: n + 1]
        kept[base] = out
    return kept[base][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of one array (bytes or 64-bit hashes), by prefix sums of a polynomial modulo 2^64.

    Bytes go through a table of random 64-bit values first. ``seed`` gives independent hashes.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        table = per_worker(f"bytes_{seed}", lambda: np.random.default_rng(0xC0FFEE + seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))
        base = (BASE ^ (seed * 0x632BE59BD9B4E018)) | 1
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        values = table[data] if data.dtype == np.uint8 else data
        np.cumsum(values * powers(base, len(data))[:-1], out=self.prefix[1:])
        self.shift = powers(pow(base, -1, 1 << 64), len(data))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.shift[start] + (end - start).astype(np.uint64))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``x[i : i + width]`` for each i with a whole window, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


#: Rows without an id are known by a hash of their text from this number on, ``1 << 61`` numbers that no id has; smaller than all ids.
NO_ID = -(1 << 63)


def id_or_text(doc_id: Column, text: Column) -> Column:
    """The id of a row, or a number made from its text where it has none."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(NO_ID))


def given_id(doc: Column) -> Column:
    """The id that ``id_or_text`` took, null where the row has none."""
    return F.when(doc >= NO_ID + (1 << 61), doc)


def bits_apart(a: Column, b: Column) -> Column:
    """Number of differing bits of two long columns."""
    return F.bit_count(a.bitwiseXOR(b))


#: Spark deletes the shuffle files of an execution at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Executions inside leave no shuffle files: their results are files, so nothing reads their shuffles again. The
    session's own setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    asegurar_checkpoint(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage like ``cut``, as a compressed table in the same shared folder: for larger intermediates.
    The table stays until ``discard``, or until the folder is cleaned up."""
    path = f"{asegurar_checkpoint(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fence(df: DataFrame) -> DataFrame:
    """The same rows, under which no later condition moves. A condition on a computed column otherwise takes its
    expression along, and costly steps run once per use; row numbers, always at least 0, stop that."""
    return df.withColumn("fence_row", F.monotonically_increasing_id()).where("fence_row >= 0").drop("fence_row")


#: Ids of rows that a semi join hands to every task at most (8 bytes each); more are shuffled instead.
SMALL_IDS = 1_000_000


def sent(ids: DataFrame) -> DataFrame:
    """A table of keys (and few bytes more) for a join: sent to every task only if its rows are counted to be few."""
    return F.broadcast(ids) if ids.count() <= SMALL_IDS else ids


def only(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; the keys are sent to every task only if they are counted to be few."""
    return df.join(sent(ids), on, "left_semi")


def but_for(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``, as ``only``."""
    return df.join(sent(ids), on, "left_anti")


def components(links: DataFrame) -> DataFrame:
    """Connected components of a link table (``a``, ``b``): one row (``node``, ``label``) per node
    that has a link, ``label`` the smallest node reachable.

    Large-star and small-star rounds: each node hands its larger neighbours, then its smaller ones,
    over to the smallest. Rounds go on until the link table no longer changes; only its row count
    and checksum reach the driver. Null ends and self links are ignored.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    seen = None
    while True:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(
            edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(root, "b").where("a != m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        small = root.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(moved)
        edges = cut(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    label = edges.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())

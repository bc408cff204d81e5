"""Importance resampling towards a target distribution.

A document's features are its words and pairs of neighbouring words, each hashed by CRC-32 into a
bucket. Bucket counts over all documents and over the target texts give each bucket a gain (the log of
the ratio of its smoothed shares); a document's weight is the mean gain of its features, and Gumbel noise
from a hash of its id makes the highest scores a sample without replacement.

The scores are ordered by parallel sorting by regular sampling: each run is sorted where it lies,
equally spaced rows of every run give equally spaced splitters, segments between splitters are
exchanged and sorted again, and prefix sums of the segments' sizes turn places into exact ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import NO_LETTER, lower_ascii, per_worker, pieces, small_batches, stored, string_offsets, word_bounds

BUCKETS = 10_000
#: Runs and segments of the sort at most, so the regular samples (``MAX_WAYS`` squared) fit the driver.
MAX_WAYS = 512
#: Words longer than this go through zlib one by one, the others together.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc_onwards(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers (before the final inversion) after the bytes of each range, from the given registers."""
    table = per_worker("crc_table", _crc_table)
    size = end - start
    out = state.copy()
    order = np.argsort(-size, kind="stable")
    long_ = int(np.searchsorted(-size[order], -LONG_WORD, "left"))
    for i in order[:long_].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[long_:]
    if not len(order):
        return out
    at, reg = start[order], state[order]
    left = np.searchsorted(-size[order], -np.arange(int(size[order[0]])), "left")  # ranges longer than 0, 1, 2, ...
    for k, n in enumerate(left.tolist()):
        reg[:n] = table[(reg[:n] ^ data[at[:n] + k]) & 0xFF] ^ (reg[:n] >> 8)
    out[order] = reg
    return out


def features(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of each row, the row of each, and the words of each row."""
    data = lower_ascii(data)
    start, end, before = word_bounds(data, off, NO_LETTER)
    words = np.diff(before)
    row = np.repeat(np.arange(len(words)), words)
    one = crc_onwards(data, start, end, np.full(len(start), 0xFFFFFFFF, np.uint32))
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    table = per_worker("crc_table", _crc_table)
    spaced = table[(one[first] ^ 0x20) & 0xFF] ^ (one[first] >> 8)
    two = crc_onwards(data, start[first + 1], end[first + 1], spaced)
    crc = np.r_[one, two] ^ np.uint32(0xFFFFFFFF)
    return (crc % np.uint32(buckets)).astype(np.int64), np.r_[row, row[first]], words


def _texts(df: DataFrame, *first: Column) -> DataFrame:
    return small_batches(df).select(*first, F.col("text").cast("string").alias("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; null texts have none. One row a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                total += np.bincount(features(*string_offsets(part.column(0)), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = _texts(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((t+1)*(S+n) / ((s+1)*(T+n))))`` of each bucket, ``n`` the number of buckets."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean gain of its features (none: 0)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                bucket, row, words = features(*string_offsets(part.column(1)), len(gain))
                n = np.maximum(2 * words - 1, 0)
                total = np.zeros(len(words), np.int64)
                np.add.at(total, row, gain[bucket])
                cols = [part.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"])

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def gumbel_scores(weighted: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: weight plus noise from the first 8 hex digits of ``sha256('<seed>:<doc_id>')`` (null id: empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise.cast("long"))


def _with_place(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Adds each row's place (from 0) in its partition, or in its partition's run of one ``key``, and the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = 0, None  # the next row's place, if it goes on with the last row's key
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(n)
            if key:
                k = batch.column(batch.schema.get_field_index(key)).to_numpy()
                new = np.maximum.accumulate(np.where(np.r_[k[0] != last, k[1:] != k[:-1]], at, -1))
                at = np.where(new < 0, at + place, at - new)
                last = k[-1]
            else:
                at = at + place
            place = int(at[-1]) + 1
            cols = [*batch.columns, pa.array(at), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, name, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` long, part int")


def ranked(rows: DataFrame, ways: int | None = None) -> DataFrame:
    """Adds ``rank`` (1, 2, 3, ...) by higher ``score``, then smaller ``doc_id`` (null ids last); equal rows in any order.

    ``ways``: runs and segments of the sort (default: the shuffle partitions), at most ``MAX_WAYS``.
    """
    spark = rows.sparkSession
    ways = max(1, min(MAX_WAYS, ways or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = rows.columns
    keyed = stored(
        rows.withColumn("high", -F.col("score")).withColumn("tie", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    ).withColumn("row", F.monotonically_increasing_id())
    order = ["high", "tie", "row"]
    # Locally sorted runs, and equally spaced rows of each.
    runs = stored(_with_place(keyed.repartition(ways, "row").sortWithinPartitions(*order), "place"))
    n = runs.count()
    stride = max(1, n // ways**2)
    sample = runs.where(F.col("place") % stride == 0).select(*order).toArrow()
    sample = sample.sort_by([(c, "ascending") for c in order])
    at = (np.arange(1, ways) * len(sample)) // ways
    split = tuple(sample[c].to_numpy()[at] if len(sample) else np.zeros(0, np.int64) for c in order)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(split[0])
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in order]
            both = [np.r_[s, o] for s, o in zip(split, own, strict=True)]
            by = np.lexsort(both[::-1])  # stable: a splitter comes before an equal row
            segment = np.zeros(len(by), np.int32)
            segment[by] = np.cumsum(by < many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[many:])], [*batch.schema.names, "segment"])

    slim = runs.drop("place", "part")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    dealt = slim.mapInArrow(segments, f"{fields}, segment int")
    size = np.zeros(ways, np.int64)
    for segment, k in dealt.groupBy("segment").count().collect():  # at most ``ways`` rows
        size[segment] = k
    before = F.lit((np.cumsum(size) - size).tolist())
    exchanged = dealt.repartitionById(ways, F.col("segment")).sortWithinPartitions("segment", *order)
    placed = _with_place(exchanged, "place", "segment")
    rank = F.element_at(before, F.col("segment") + 1) + F.col("place") + 1
    return placed.select(*names, rank.cast("long").alias("rank"))


def importance_resampling(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, ways: int | None = None
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``rank`` is 1, 2, 3, ... for the ``floor(percent * N / 100)`` highest scores of the N rows with at least
    ``least_words`` words, and null for the others. Ties go to the smaller doc_id, null ids last. Null
    texts have no words: weight 0. Repeated rows count each and are ranked apart; rows that share an id share
    their noise. Other columns are ignored; empty inputs give empty counts or an empty result.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = stored(gumbel_scores(weights(docs, gain), seed))
    allowed = scored.where(F.col("n_words") >= least_words)
    draw = allowed.count() * percent // 100
    drawn = ranked(allowed, ways).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

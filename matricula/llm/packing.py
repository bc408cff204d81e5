"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids and, where longer than a sequence, pieces. Packing needs only how many
pieces have each length, at most one number per length up to the capacity, so the plan is made from
that histogram: first small sets are fixed for good that provably dominate every other way to fill a
sequence around their longest piece, then the rest is packed by best fit in decreasing order. The plan is a list
of runs: so many equal pieces, at the same offset of so many sequences. Pieces are numbered among
those of their length by counts per partition, and a piece's number finds its run, so no piece leaves
its partition but to meet its count.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matricula.llm import wordbpe
from matricula.llm.base import pieces, small_batches, stored

CAPACITY = 4096
#: Texts are encoded in pieces of about so many bytes: larger ones have fewer different words for their size.
PIECE = 1 << 20


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and ``end_id``, cut into pieces of ``capacity``
    tokens (the last may be shorter). ``ids``: little-endian unsigned 32-bit integers.

    Null and empty texts: ``end_id`` alone. Repeated rows and null ids give their own pieces. ``path``
    names a tokenizer definition on the driver (see ``wordbpe.checked``); its size bounds what is broadcast.
    """
    with open(path, encoding="utf-8") as f:
        sent = small_batches(docs).sparkSession.sparkContext.broadcast(wordbpe.checked(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordbpe.encoder(sent.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                names = part.column(0).to_pylist()
                found = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                out: list[list] = [[], [], [], [], []]
                for name, ids in zip(names, found, strict=True):
                    ids = np.append(ids, np.array([end_id], "<u4"))
                    for i, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a : a + capacity]
                        for column, x in zip(out, (name, i, a, len(own), own.tobytes()), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


class Lengths:
    """How many pieces of each length are left, with their lengths in order."""

    def __init__(self, count: dict[int, int]):
        self.count = {s: n for s, n in count.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.order[bisect_left(self.order, length)]

    def smallest(self, k: int, but: int) -> int | None:
        """Sum of the ``k`` smallest pieces besides one of length ``but``; None if there are fewer."""
        total = 0
        for s in self.order:
            n = min(k, self.count[s] - (s == but))
            total, k = total + n * s, k - n
            if not k:
                return total
        return None

    def largest(self, room: int, *but: int) -> int | None:
        """The longest piece of at most ``room`` besides pieces of the lengths ``but``."""
        i = bisect_right(self.order, room)
        while i:
            i -= 1
            if self.count[self.order[i]] > but.count(self.order[i]):
                return self.order[i]
        return None


def dominant(left: Lengths, s: int, capacity: int) -> tuple[int, ...] | None:
    """A set around a piece of length ``s`` that dominates every other set with it, by the criterion of Martello
    and Toth, or None: of two sets the first dominates if the second's pieces can be dealt out to groups,
    each no longer than a piece of its own of the first."""
    room = capacity - s
    best = left.largest(room, s)
    if best is None:
        return (s,)  # nothing fits beside it
    if best == room:
        return (s, best)  # all that fits beside it fits in one piece's place
    two = left.smallest(2, s)
    if two is None or two > room:
        return (s, best)  # at most one piece fits beside it
    three = left.smallest(3, s)
    if three is not None and three <= room:
        return None
    # At most two pieces fit beside it: the longest pair, and the pair with the longest second piece.
    longest, second = 0, 0
    for a in left.order[: bisect_right(left.order, room)]:
        if left.count[a] <= (a == s):
            continue
        b = left.largest(min(a, room - a), s, a)
        if b is not None:
            longest, second = max(longest, a + b), max(second, b)
    if best >= longest:
        return (s, best)
    b = left.largest(room - best, s, best)
    if b is not None and b >= second:
        return (s, best, b)
    return None


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, pieces, first sequence, pieces a sequence, offset): the pieces of this
    length with numbers from ``first number`` on lie, ``pieces a sequence`` together, at ``offset`` of the
    sequences from ``first sequence`` on. Lengths are from 1 to ``capacity``."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(count, 0)
    left = Lengths(count)
    sequences = 0

    def lay(s: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((s, used[s], n, first, each, offset))
        used[s] += n
        left.take(s, n)

    # Reduction, from the longest pieces down, again until no set is fixed.
    changed = True
    while changed:
        changed = False
        for s in left.order[::-1]:
            while s in left.count and (fixed := dominant(left, s, capacity)):
                each = {x: fixed.count(x) for x in fixed}
                many = min(left.count[x] // k for x, k in each.items())
                offset = 0
                for x, k in each.items():
                    lay(x, many * k, sequences, k, offset)
                    offset += x * k
                sequences += many
                changed = True
    # Best fit of the rest: open sequences with as much room lie together.
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def keep(first: int, many: int, room: int) -> None:
        if many and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, many))

    for s in left.order[::-1]:
        while s in left.count:
            n = left.count[s]
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first, many = capacity, sequences, -(-n // (capacity // s))
                sequences += many
            each = room // s
            full = min(many, n // each)
            if full:
                lay(s, full * each, first, each, capacity - room)
                keep(first, full, room - each * s)
                n -= full * each
            if full < many and n:  # fewer than fill one more
                lay(s, n, first + full, n, capacity - room)
                keep(first + full, 1, room - n * s)
                full += 1
            keep(first + full, many - full, room)
    return runs


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``lengths`` (a column ``length`` and any others) with ``sequence_id`` and ``offset`` long: places
    in sequences of at most ``capacity`` tokens, without gaps from 0, in as few sequences as the method finds.

    Equal rows get places of their own. A length that is null, below 1 or above ``capacity`` has no place:
    both columns are null. Columns of the input named ``sequence_id``, ``offset``, ``pack_part`` or
    ``pack_number`` are replaced. No rows give no rows. The driver gets one count for each length.
    """
    rows = lengths.drop("sequence_id", "offset", "pack_part", "pack_number")
    at = rows.columns.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            s = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            s = np.where((s < 1) | (s > capacity), 0, s)
            order = np.argsort(s, kind="stable")
            place = np.zeros(len(s), np.int64)
            place[order] = np.arange(len(s)) - np.searchsorted(s[order], s[order])
            own = place + seen[s]
            seen += np.bincount(s, minlength=capacity + 1)
            cols = [*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "pack_part", "pack_number"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = stored(rows.mapInArrow(number, f"{fields}, pack_part int, pack_number long"))
    fits = F.col("length").between(1, capacity)
    per = stored(numbered.where(fits).groupBy("pack_part", "length").agg(F.count(F.lit(1)).alias("n")))
    runs = plan({int(s): int(n) for s, n in per.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("pack_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pack_before"))
    runs.sort()  # by length and first number
    sent = numbered.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))  # a few runs a length

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, number_: pa.Array) -> pa.Array:
        size, begin, _, first, each, offset = sent.value.T
        s, n = (x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for x in (length, number_))
        i = np.searchsorted((size << 44) + begin, (s << 44) + n, "right") - 1
        k = n - begin[i]
        cols = [pa.array(first[i] + k // each[i]), pa.array(offset[i] + k % each[i] * s)]
        return pa.StructArray.from_arrays(cols, ["sequence_id", "offset"])

    joined = numbered.where(fits).join(offsets, ["pack_part", "length"])
    spot = place(F.col("length").cast("long"), F.col("pack_before") + F.col("pack_number"))
    placed = joined.withColumn("spot", spot).select(*rows.columns, "spot.sequence_id", "spot.offset")
    none = F.lit(None).cast("long")
    return placed.unionByName(
        numbered.where(~F.coalesce(fits, F.lit(False))).select(*rows.columns, none.alias("sequence_id"), none.alias("offset"))
    )


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document: ``tokenised`` pieces with
    a digest in place of their ids, packed."""
    found = tokenised(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(found, capacity)

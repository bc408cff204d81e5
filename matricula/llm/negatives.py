"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, ``floor(scale * x)``. Each candidate is packed into bit planes of two's
complement: one byte per plane and group of eight dimensions. For each anchor and group, a table holds
the sums of all 256 subsets of the anchor's eight components, so a plane's share of an inner product is
one lookup per group, and the planes are joined by shift and add. Scores are exact.

Anchors are taken in stripes of bounded size. A stripe is sent to every task, which scores its
candidates in blocks and keeps only its own best rows of each anchor (and positive); a window takes the
best of those. So no task holds more than a stripe, and no pair is written that could not be returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matricula.llm.base import cut
from matricula.sesion import asegurar_checkpoint

#: Bytes of packed anchors in a stripe, in expectation: what is broadcast at once.
STRIPE_BYTES = 4 << 20
#: Candidates and anchors that are scored at once.
ROWS, WIDE = 1024, 64
#: Candidates of a task at least; more rows make more tasks, up to four a core.
TASK_ROWS = 4096

LEAST = np.int64(np.iinfo(np.int64).min)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(embedding: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of all components in one array, the row of each, and whether a row is usable:
    given, and every component given and finite. Values beyond 62 bits stop there."""
    size = pc.list_value_length(embedding)
    given = np.asarray(pc.is_valid(embedding).to_numpy(zero_copy_only=False), bool)
    row = np.repeat(np.arange(len(embedding)), pc.fill_null(size, 0).to_numpy(zero_copy_only=False))
    x = pc.cast(embedding.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    fine = np.isfinite(x)
    given[row[~fine]] = False
    x = np.floor(np.where(fine, x, 0.0) * float(scale))
    return np.clip(x, -float(1 << 61), float(1 << 61)).astype(np.int64), row, given


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: bit ``b`` of a group's byte in plane ``k`` is bit ``k`` of dimension ``8 * group + b``."""
    rows, dims = q.shape
    out = np.zeros((rows, planes, -(-dims // 8)), np.uint8)
    for k in range(planes):
        out[:, k] = np.packbits(((q >> k) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def from_planes(bytes_: np.ndarray) -> np.ndarray:
    """The whole numbers (rows, dimensions up to a multiple of 8) of ``bit_planes``."""
    rows, planes, groups = bytes_.shape
    q = np.zeros((rows, groups * 8), np.int64)
    for k in range(planes):
        q += np.unpackbits(bytes_[:, k], axis=1, bitorder="little") * np.int64(-(1 << k) if k == planes - 1 else 1 << k)
    return q


def subset_sums(anchors: np.ndarray, planes: int) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of each group of eight components. 32 bits where every
    score fits, else 64 (sums then wrap as longs do)."""
    n, dims = anchors.shape
    most = int(np.abs(anchors.astype(np.int64)).max(initial=0)) * dims << planes
    t = np.zeros((dims // 8, 256, n), np.int32 if most < 1 << 31 else np.int64)
    q = anchors.T.reshape(dims // 8, 8, 1, n).astype(t.dtype)
    for b in range(8):
        t[:, 1 << b : 2 << b] = t[:, : 1 << b] + q[:, b]
    return t


def scores(table: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products: a lookup per plane and group, planes by shift and add."""
    rows, planes, groups = bytes_.shape
    total = np.zeros((rows, table.shape[2]), table.dtype)
    looked = np.empty_like(total)
    for k in range(planes - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(table[g], bytes_[:, k, g], axis=0, out=looked, mode="clip")  # a byte is always in range
            if k == planes - 1:
                total -= looked
            else:
                total += looked
    return total


class Best:
    """The ``k`` best (score, id) of each of ``n`` queues: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST, np.int64)
        self.id = np.zeros((n, k), np.int64)

    def add(self, queue: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Offer entries; a score of ``LEAST`` counts as none."""
        if not len(queue):
            return
        own = np.unique(queue)
        held = self.score[own] != LEAST
        q = np.r_[np.repeat(own, held.sum(1)), queue]
        s, i = np.r_[self.score[own][held], score], np.r_[self.id[own][held], id_]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[own] = LEAST
        self.score[q[top], place[top]] = s[top]
        self.id[q[top], place[top]] = i[top]

    def offer(self, first: int, x: np.ndarray, ids: np.ndarray) -> None:
        """Offer a matrix (candidates, queues from ``first`` on); ``LEAST`` marks what is no candidate."""
        k, width = self.k, x.shape[1]
        worst = self.score[first : first + width, -1]
        hit = (x >= worst) & (x != LEAST)
        if len(x) > k and np.count_nonzero(hit) > 4 * k * width:
            hit &= x >= np.partition(x, len(x) - k, axis=0)[len(x) - k]
        row, col = np.nonzero(hit)
        self.add(col + first, x[row, col].astype(np.int64), ids[row])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        queue, place = np.nonzero(self.score != LEAST)
        return queue, self.score[queue, place], self.id[queue, place]


def _packed(vectors: DataFrame, scale: int) -> tuple[DataFrame | None, int, int, int]:
    """(vec_id, label, planes) of every row that takes part, one per id; its rows, planes and groups."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, row, fine = whole_numbers(batch.column(2), scale)
            q = q[fine[row]]
            size = np.bincount(row, minlength=len(fine))[fine]
            wide = np.where(q < 0, ~q, q).max(initial=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(fine.sum())]), pa.array([int(size.max(initial=0))]), pa.array([int(wide)])], ["n", "dims", "wide"]
            )

    n, dims, wide = (
        vectors.mapInArrow(stats, "n long, dims long, wide long").agg(F.sum("n"), F.max("dims"), F.max("wide")).first()
    )
    if not n:
        return None, 0, 0, 0
    planes, groups = int(wide).bit_length() + 1, max(1, -(-dims // 8))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, row, fine = whole_numbers(batch.column(2), scale)
            full = np.zeros((len(fine), groups * 8), np.int64)
            first = np.searchsorted(row, row)
            full[row, np.arange(len(row)) - first] = q
            bytes_ = bit_planes(full, planes)[fine]
            keep = pa.array(fine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([x.tobytes() for x in bytes_], pa.binary())],
                ["vec_id", "label", "planes"],
            )

    tasks = max(1, min(-(-n // TASK_ROWS), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    rows = vectors.mapInArrow(pack, "vec_id long, label long, planes binary").repartition(tasks, "vec_id")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "planes")).alias("r"))
    return cut(one.select("vec_id", "r.label", "r.planes")), n, planes, groups


def _matrix(col: pa.Array, planes: int, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, planes, groups)


def _blocks(batches, sent, planes: int, groups: int):
    """Each block of candidates with each group of anchors: ids, labels, first anchor, scores. The tables of a
    group are made for each batch, a few hundredths of its work, so that only one group's are held."""
    anchors = sent.value["q"]
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        bytes_ = _matrix(batch.column(2), planes, groups)
        for a in range(0, len(anchors) if len(ids) else 0, WIDE):
            table = subset_sums(anchors[a : a + WIDE], planes)
            for r in range(0, len(ids), ROWS):
                yield ids[r : r + ROWS], labels[r : r + ROWS], a, scores(table, bytes_[r : r + ROWS])


def _best_of(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def part_of(p: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of whole numbers, rounded up or down, without overflow."""
    if up:
        return -part_of(-p, percent, False)
    whole, rest = np.divmod(p, 100)
    return whole * percent + rest * percent // 100


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column | str,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    stripe_bytes: int = STRIPE_BYTES,
) -> DataFrame:
    """Hard negatives of rows (vec_id, embedding, label): ``RESULT`` columns.

    Each component ``x`` becomes ``floor(scale * x)``; a row's score is its integer inner product with the
    anchor. Anchors are the rows where ``is_anchor`` (on vec_id and label) holds. An anchor's positives are
    its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels
    are returned whose score is from ``low`` to ``high`` percent of the positive's. Higher scores come first,
    then smaller ids.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Of rows
    that share an id, the one with the smallest (label, packed vector) counts. Shorter vectors count as filled with
    zeros; other columns are ignored; no usable row or anchor gives an empty result. Scores beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    rows, n, planes, groups = _packed(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
            "vec_id IS NOT NULL AND label IS NOT NULL"
        ),
        scale,
    )
    if rows is None:
        return spark.createDataFrame([], RESULT)
    anchors = rows.where(is_anchor)
    stripes = max(1, -(-anchors.count() * (planes * groups + 16) // stripe_bytes))
    folder = f"{asegurar_checkpoint(spark)}/negatives-{uuid.uuid4().hex}"
    for stripe in range(stripes):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(stripes)) == stripe) if stripes > 1 else anchors
        table = mine.toArrow().sort_by("vec_id")
        q = from_planes(_matrix(table["planes"], planes, groups))
        own = {
            "id": table["vec_id"].to_numpy(),
            "label": table["label"].to_numpy(),
            "q": q.astype(np.int32) if planes <= 32 else q,
        }
        sent = spark.sparkContext.broadcast(own)

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            a_id, a_label = sent.value["id"], sent.value["label"]
            best = Best(len(a_id), positives)
            for ids, labels, a, s in _blocks(batches, sent, planes, groups):
                same = (labels[:, None] == a_label[a : a + WIDE]) & (ids[:, None] != a_id[a : a + WIDE])
                best.offer(a, np.where(same, s, LEAST), ids)
            queue, score, id_ = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(queue), pa.array(score), pa.array(id_)], ["a", "score", "vec_id"])

        found = _best_of(rows.mapInArrow(near, "a long, score long, vec_id long"), ["a"], positives).select("a", "rank", "score", "vec_id")
        found = found.toArrow()  # at most ``positives`` rows for each anchor of the stripe
        slot = found["a"].to_numpy() * positives + found["rank"].to_numpy() - 1
        p_score, p_id = np.zeros(len(own["id"]) * positives, np.int64), np.zeros(len(own["id"]) * positives, np.int64)
        lo, hi = np.ones_like(p_score), np.zeros_like(p_score)  # no score lies between: a missing positive
        p_score[slot], p_id[slot] = found["score"].to_numpy(), found["vec_id"].to_numpy()
        lo[slot], hi[slot] = part_of(p_score[slot], low, True), part_of(p_score[slot], high, False)
        bounds = spark.sparkContext.broadcast((lo.reshape(-1, positives), hi.reshape(-1, positives), p_score, p_id))

        def far(batches: Iterator[pa.RecordBatch], sent=sent, bounds=bounds) -> Iterator[pa.RecordBatch]:
            a_id, a_label = sent.value["id"], sent.value["label"]
            lo, hi, p_score, p_id = bounds.value
            best = [Best(len(a_id), negatives) for _ in range(positives)]
            for ids, labels, a, s in _blocks(batches, sent, planes, groups):
                other = labels[:, None] != a_label[a : a + WIDE]
                for j in range(positives):
                    inside = other & (s >= lo[a : a + WIDE, j]) & (s <= hi[a : a + WIDE, j])
                    if inside.any():
                        best[j].offer(a, np.where(inside, s, LEAST), ids)
            for j in range(positives):
                queue, score, id_ = best[j].rows()
                at = queue * positives + j
                cols = [a_id[queue], p_id[at], p_score[at], score, id_]
                names = ["anchor_id", "positive_id", "positive_score", "score", "vec_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        out = rows.mapInArrow(far, "anchor_id long, positive_id long, positive_score long, score long, vec_id long")
        out = _best_of(out, ["anchor_id", "positive_id"], negatives)
        out.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(f"{folder}/stripe={stripe}")
        sent.unpersist()
        bounds.unpersist()
    return spark.read.schema(f"{RESULT}, stripe int").parquet(folder).drop("stripe")


#: The query in DuckDB SQL, on table ``embeddings``.
ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * c.q[i])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

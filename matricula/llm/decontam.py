"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

The benchmark is the query set; it is held in blocks of a bounded number of words. A copy that scores the share
``least`` has at least that share of the item's words in their places, so of any ``k`` more places than it may miss, it has
``k`` whatever the edits are: the seeds of an item are the words at so many of its rarest places, and a stretch of a document that
can hold a copy has ``k`` of them. Rarity is counted over all documents. Documents are joined with the items through the
seeds; in such stretches, where enough of all the item's words occur, the item is aligned with the document by local alignment of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import NO_LETTER, Rolling, cut, pieces, small_batches, string_offsets, word_bounds

MATCH, MISMATCH, GAP = 2, -1, -1


def text_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (ASCII punctuation dropped), and the number of words before each."""
    start, end, before = word_bounds(data, off, NO_LETTER)
    return Rolling(data).of(start, end), before


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first word, word after the last) in ``text``.

    The row's horizontal gaps are a running maximum, so a row is a few array operations."""
    cols = np.arange(len(text) + 1)
    prev, prev_from = np.zeros(len(text) + 1, np.int64), cols.copy()
    best = (0, 0, 0)
    for w in item:
        diag = prev[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        use = diag >= up
        h, origin = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
        h[1:] = np.where(use, diag, up)
        origin[1:] = np.where(use, prev_from[:-1], prev_from[1:])
        fresh = h <= 0
        h[fresh], origin[fresh] = 0, cols[fresh]
        lifted = h - GAP * cols
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, cols, 0))  # where the running maximum was last reached
        prev, prev_from = top + GAP * cols, origin[at]
        j = int(prev.argmax())
        if prev[j] > best[0]:
            best = (int(prev[j]), int(prev_from[j]), j)
    return best


def _regions(at: np.ndarray, reach: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Stretches of words [lo, hi) up to ``reach`` around the words ``at`` (ascending), joined where they meet."""
    a, b = np.maximum(at - reach, lo), np.minimum(at + reach + 1, hi)
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    last = np.r_[new[1:], len(a)] - 1
    yield from zip(a[new].tolist(), b[last].tolist(), strict=True)


def _most(own: np.ndarray, times: np.ndarray, text: np.ndarray) -> int:
    """Bound of the alignment score of an item, given as different words in order with their counts, with ``text``: its words that
    occur there are matched at most, and of an aligned stretch each word that is none of the item's costs a mismatch or a gap."""
    at = np.minimum(np.searchsorted(own, text), len(own) - 1)
    hit = own[at] == text
    there = np.zeros(len(own), bool)
    there[at[hit]] = True
    total = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.where(hit, MATCH, max(MISMATCH, GAP)), out=total[1:])
    return min(MATCH * int(times[there].sum()), int((total - np.minimum.accumulate(total)).max()))


def _item_words(bench: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, before = text_words(*string_offsets(part.column(1)))
                lists = [words[a:b].view(np.int64) for a, b in zip(before, before[1:], strict=False)]
                cols = [part.column(0), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "words"])

    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    return rows.where("item_id is not null").mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)


class _Vocabulary:
    """A set of word hashes, looked up by a table of their high bits first."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``words`` that are in the set, and their numbers there."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        ok = self.words[number] == words[at]
        return at[ok], number[ok]


def word_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of the different ``words`` (in order) occurs in all documents. One row a word and task is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(_Vocabulary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                own, _ = text_words(*string_offsets(part.column(1)))
                total += np.bincount(known.find(own)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    found = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out


#: A copy must hold so large a part of an item's seeds, in words of the item.
PART = 8


def seeds(item: np.ndarray, frequency: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The rarest places of an item, and how many of them a copy of the share ``least`` has at least."""
    holds = int(np.ceil(least * len(item) - 1e-9))
    k = min(-(-len(item) // PART), holds)
    return np.argsort(frequency, kind="stable")[: len(item) - holds + k], k


def contaminated(docs: DataFrame, bench: DataFrame, least: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): documents that hold a copy of a benchmark item.

    ``score``: alignment score by that of a whole copy of the item, at least ``least`` (above 0); the words are
    those of the best alignment. The result is that of aligning every item with every document. An item
    without words matches nothing, nor does a null id. Repeated rows of a document give equal rows.
    ``block_words`` bounds the benchmark words held at once; every block is held against all documents.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, and 1 at most")
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    items = cut(_item_words(bench))
    total = items.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    blocks = -(-total // block_words)
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for b in range(blocks):  # expected block_words each, by a hash of the item
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        out = out.unionByName(_search(docs, [(r.item_id, np.array(r.words, np.int64).view(np.uint64)) for r in own], least))
    return out


def _search(docs: DataFrame, items: list[tuple[int, np.ndarray]], least: float) -> DataFrame:
    words = np.unique(np.concatenate([w for _, w in items]))
    count = word_counts(docs, words)
    found, size = [], np.array([len(w) for _, w in items], np.int64)
    needed = np.zeros(len(items), np.int64)
    for k, (_, w) in enumerate(items):
        place, needed[k] = seeds(w, count[np.searchsorted(words, w)], least)
        found += [(x, k) for x in np.unique(w[place])]
    found.sort()
    known = _Vocabulary(np.array([x[0] for x in found], np.uint64))
    first = np.searchsorted(np.array([x[0] for x in found], np.uint64), known.words)
    # A copy adds so many words at most; all its words lie within ``reach`` of each other.
    reach = size + (2 * size * (1 - least)).astype(np.int64) + 1
    held = docs.sparkSession.sparkContext.broadcast(
        (known, np.r_[first, len(found)], np.array([x[1] for x in found], np.int64), needed, reach, items)
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, where, needed, reach, items = held.value
        vocabulary = {}
        names = ["doc_id", "item_id", "score", "first_word", "end_word"]
        for batch in batches:
            for part in pieces(batch, "text"):
                words, before = text_words(*string_offsets(part.column(1)))
                ids, rows = part.column(0).to_pylist(), []
                at, number = known.find(words)
                times = first[number + 1] - first[number]  # items with this word
                item = where[np.repeat(first[number] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                at = np.repeat(at, times)
                pair = (np.searchsorted(before, at, "right") - 1) * len(items) + item
                order = np.lexsort((at, pair))
                at, pair = at[order], pair[order]
                # Seeds of the same document and item from here on, as far as a copy reaches.
                spread = pair * (2 * len(words) + 1) + at
                far = np.minimum(reach[pair % len(items)], len(words))
                keep = np.searchsorted(spread, spread + far, "right") - np.arange(len(at)) >= needed[pair % len(items)]
                at, pair = at[keep], pair[keep]
                new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(at) else []
                for a, b in zip(new, np.r_[new[1:], len(at)] if len(at) else [], strict=True):
                    row, k = divmod(int(pair[a]), len(items))
                    lo, hi = int(before[row]), int(before[row + 1])
                    item_id, w = items[k]
                    if k not in vocabulary:
                        vocabulary[k] = np.unique(w, return_counts=True)
                    best = (0, 0, 0)
                    for x, y in _regions(at[a:b], int(reach[k]), lo, hi):
                        most = _most(*vocabulary[k], words[x:y])
                        if most <= best[0] or most < least * MATCH * len(w):
                            continue
                        score, i, j = align(w, words[x:y])
                        if score > best[0]:
                            best = (score, x + i - lo, x + j - lo)
                    share = best[0] / (MATCH * len(w))
                    if share >= least and ids[row] is not None:
                        rows.append((ids[row], item_id, share, best[1], best[2]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return docs.mapInArrow(find, "doc_id long, item_id long, score double, first_word long, end_word long")

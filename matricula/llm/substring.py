"""Near-duplicate passages by compact windows.

A text is its sequence of word shingles. Under one hash function, all subsequences of at least
``t`` shingles that have their least hash at position c form one compact window (l, c, r): the node of
a Cartesian tree over the hashes. There are about 2n / t windows, and two texts that share a passage
share windows with equal least hashes, whatever stands around the passage. The joins are on that
hash under several functions; the places around c are then compared exactly.

Windows with equal surroundings are one class, counted before they are joined, so groups of
copies are a few rows. Classes that share a hash are compared with the first of them, by sketches and
then by their texts. Those that are not near it are dealt out anew by the sketch values in which
they differ from it, and so on until no group has two classes: a line that is in a large part of
all texts is the same in all and so brings no two of them together again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import Rolling, cut, discard, given_id, id_or_text, mix, only, pieces, small_batches, stored, string_offsets, window_min, word_bounds

SHINGLE = 5
#: Least passage: 50 words.
LEAST = 50 - SHINGLE + 1
#: Functions whose least hashes are joined: of two passages of least length with similarity s, a share of 1 - (1 - s) ** HASHES meet.
HASHES = 3
#: Functions of the sketches, and the distances from c that these are of: a passage around c covers all of them on one side
#: at least, and a short line around c none.
SKETCHES, NEAR, FAR = 4, 8, LEAST // 2
#: Bits of a sketch value: so many that texts which share no more than a line hardly ever agree in one.
BITS = 64 // SKETCHES
SIMILARITY = 0.8
#: Of similar passages, an unbroken stretch has so many shingles at least: with k edits, each at least 9 shingles of the union,
#: the longest of k + 1 stretches has 36 k / (k + 1).
UNBROKEN = 16
#: Places that are listed at once; texts that repeat a shingle more often than that take the longer way.
PLACES = 1 << 16
#: Places of two texts that are kept in order of their distance; of more, all are looked through for each distance.
BUCKETED = 1 << 19


def _function(shingles: np.ndarray, i: int) -> np.ndarray:
    return mix(shingles ^ np.uint64((i + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def text_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, the number of shingles before each text, the words' hashes and the number of words
    before each text."""
    start, end, before = word_bounds(data, off)
    words = Rolling(data).of(start, end)
    count = np.maximum(np.diff(before) - SHINGLE + 1, 0)
    at = np.r_[0, np.cumsum(count)]
    first = np.repeat(before[:-1] - at[:-1], count) + np.arange(at[-1])
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[first + k])
    return h, at, words, before


def compact_windows(h: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (row, l, c, r) of ``t`` or more elements, ends included, of each row's Cartesian tree.

    A node with t or more elements is the least of some t neighbours, and so are the smaller elements
    that bound it. So only these, about 2n / t, go through the stack that builds the tree."""
    starts = np.maximum(np.diff(at) - t + 1, 0)
    total = int(starts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    place = np.uint64((1 << 28) - 1)
    least = (window_min((h & ~place) | np.arange(len(h), dtype=np.uint64), t) & place).astype(np.int64)
    row = np.repeat(np.arange(len(starts)), starts)
    c = least[at[:-1][row] + np.arange(total) - (np.cumsum(starts) - starts)[row]]
    new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (row[1:] != row[:-1])])
    c, row = c[new], row[new]
    left, right = at[row].copy(), at[row + 1] - 1
    value, rows, places = ((h[c] & ~place) | c.astype(np.uint64)).tolist(), row.tolist(), c.tolist()
    stack: list[int] = []
    for i in range(len(places)):
        if stack and rows[stack[0]] != rows[i]:
            stack.clear()
        while stack and value[stack[-1]] > value[i]:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return row, left, c, right


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc, tag, text): rows are known by id and a hash of their text; repeated rows are one text, rows without an id come first."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(docs).select(id_or_text(F.col("doc_id"), t).alias("doc"), F.shiftright(F.xxhash64(t), 32).cast("int").alias("tag"), t.alias("text"), *more)


_WINDOW = "doc long, tag int, key long, place long, content long, sketch long, sketch_after long"
_REACH = 64  # place: (c * _REACH + shingles of the window before c) * _REACH + shingles after c


def _windows(docs: DataFrame) -> DataFrame:
    """Compact windows of all texts under ``HASHES`` functions: ``key`` the least hash, ``place`` its shingle c and how far the window
    goes around c, less than ``LEAST`` on either side, ``content`` a hash of the words there, ``sketch`` the least hashes (``BITS`` bits each)
    under ``SKETCHES`` functions of the shingles ``NEAR`` to ``FAR`` before c, ``sketch_after`` those after c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _WINDOW.split(", ")]
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at, words, before = text_shingles(*string_offsets(part.column(2)))
                if not (np.diff(at) >= LEAST).any():
                    continue
                hashed = [_function(h, i) for i in range(SKETCHES)]
                aside = [window_min(x, FAR - NEAR) for x in hashed]
                content = Rolling(words)
                found = [(i, *compact_windows(hashed[i], at, LEAST)) for i in range(HASHES)]
                key = np.concatenate([hashed[i][c] for i, _, _, c, _ in found])
                row, left, c, right = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
                lo, hi = np.maximum(left, c - LEAST + 1), np.minimum(right, c + LEAST - 1)
                to_word = (before[:-1] - at[:-1])[row]
                sketches = []
                for side in (np.maximum(c - FAR, at[row]), np.minimum(c + 1 + NEAR, at[row + 1] - FAR + NEAR)):
                    sketch = np.zeros(len(c), np.uint64)
                    for x in aside:
                        sketch = (sketch << np.uint64(BITS)) | (mix(x[side]) >> np.uint64(64 - BITS))
                    sketches.append(pa.array(sketch.view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take), pa.array(key.view(np.int64)),
                        pa.array(((c - at[row]) * _REACH + c - lo) * _REACH + hi - c),
                        pa.array(content.of(lo + to_word, hi + to_word + SHINGLE).view(np.int64)), *sketches,
                    ],
                    names,
                )

    return docs.mapInArrow(run, _WINDOW)


def _keys(docs: DataFrame) -> DataFrame:
    """The column ``key`` of ``_windows`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at, _, _ = text_shingles(*string_offsets(part.column(0)))
                if (np.diff(at) >= LEAST).any():
                    found = [(x, *compact_windows(x, at, LEAST)) for x in (_function(h, i) for i in range(HASHES))]
                    key = np.concatenate([x[0][x[3]] for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


class _Run:
    """A stretch [a, b) of one text and [x, y) of the other with ``m`` shingles in common; ``parts``: what it was joined from."""

    __slots__ = ("a", "b", "x", "y", "m", "parts")

    def __init__(self, a, b, x, y, m, parts=()):
        self.a, self.b, self.x, self.y, self.m, self.parts = a, b, x, y, m, parts

    def joined(self, o: _Run) -> _Run | None:
        """Both as one stretch, if so many shingles of it are in common that it can be similar enough."""
        a, b, x, y, m = self.a, o.b, self.x, o.y, self.m + o.m
        if o.x < self.y or m < SIMILARITY * (b - a + y - x - m):
            return None
        return _Run(a, b, x, y, m, (self, o))


class _Ranked:
    """The shingles of a text, and the same in order with their places."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.order = np.argsort(shingles, kind="stable")
        self.ranked = shingles[self.order]
        self.repeats = bool((self.ranked[1:] == self.ranked[:-1]).any())

    @cached_property
    def places(self) -> np.ndarray:
        """Rank of the shingle, times the number of places, and its place: ascending in the order of ``ranked``."""
        return np.cumsum(np.r_[0, self.ranked[1:] != self.ranked[:-1]]) * len(self.order) + self.order

    @cached_property
    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``UNBROKEN`` shingles in order, with their places."""
        h = _stretches(self.shingles)
        order = np.argsort(h, kind="stable")
        return h[order], order


def _stretches(shingles: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(shingles) - UNBROKEN + 1))
    return Rolling(shingles).of(at, at + UNBROKEN)


def _common_runs(text: np.ndarray, there_: _Ranked, same: bool) -> list[_Run]:
    """Stretches that both texts have shingle by shingle, in the order of ``text``: at each shingle the one that
    continues the stretch before, else the first in ``other``. With ``same``, only stretches from earlier in the text."""
    other, order, ranked = there_.shingles, there_.order, there_.ranked
    if not len(text) or not len(other):
        return []
    place = np.minimum(np.searchsorted(ranked, text), len(ranked) - 1)
    there = order[place]
    match = ranked[place] == text
    if same:
        match &= there < np.arange(len(text))
    at = np.flatnonzero(match)
    runs, i, shift = [], 0, None
    while i < len(at):
        p = int(at[i])
        q = p + shift if shift is not None else -1
        if not (0 <= q < len(other) and other[q] == text[p]):
            q = int(there[p])
        n = min(len(text) - p, len(other) - q)
        size = 32
        while True:  # grow until a difference is in sight
            k = min(n, size)
            differ = np.flatnonzero(text[p : p + k] != other[q : q + k])
            if len(differ) or k == n:
                break
            size *= 4
        k = int(differ[0]) if len(differ) else n
        runs.append(_Run(p, p + k, q, q + k, k))
        shift = q - p
        i = int(np.searchsorted(at, p + k))
    return runs


class _Near:
    """For each shingle of ``text`` its places in ``there`` (with ``same``: those before it), as ranges of ``there.order``."""

    def __init__(self, text: np.ndarray, there: _Ranked, same: bool):
        n, self.there = len(there.order), there
        lo = np.searchsorted(there.ranked, text)
        rank = there.places[np.minimum(lo, n - 1)] // n * n
        hi = np.searchsorted(there.places, rank + np.arange(len(text))) if same else np.searchsorted(there.ranked, text, "right")
        hi = np.where(there.ranked[np.minimum(lo, n - 1)] == text, hi, lo)
        self.at = np.flatnonzero(hi > lo)
        self.lo, self.hi, self.rank = lo[self.at], hi[self.at], rank[self.at]
        count = self.hi - self.lo
        self.size, self.buckets, self.kept = len(text), None, {}
        self.followed, self.ahead = {}, 4
        if count.sum() <= BUCKETED:
            r, k = _ranges(self.lo, count)
            bucket = (there.order[k] - self.at[r]) // LEAST
            order = np.argsort(bucket, kind="stable")
            self.buckets, self.of_bucket = bucket[order], r[order]

    def _around(self, c: int) -> tuple[np.ndarray, bool]:
        """The shingles (as numbers in ``at``) that have a place so far off that it may be near to a shift of bucket ``c``, and
        whether they are so many that ``runs`` can make up a passage."""
        if c not in self.kept:
            lo, hi = np.searchsorted(self.buckets, c - 1), np.searchsorted(self.buckets, c + 1, "right")
            some = np.unique(self.of_bucket[lo:hi])
            self.kept[c] = some, _dense(self.at[some], self.size, LEAST)
        return self.kept[c]

    def enough(self, shift: np.ndarray) -> np.ndarray:
        """Whether so many shingles have a place near to each shift that ``runs`` can make up a passage."""
        if self.buckets is None:
            return np.ones(len(shift), bool)
        centre, back = np.unique(shift // LEAST, return_inverse=True)
        return np.array([self._around(c)[1] for c in centre.tolist()], bool)[back]

    def runs(self, shift: int, after: list[int]) -> list[_Run]:
        """``_common_runs`` of each shingle's place nearest to ``shift`` after its own, and not farther from it than ``LEAST``;
        none, if they cannot be joined to a passage. ``after``: the shifts to follow next, looked at together with this one."""
        if shift not in self.followed:
            self._follow([shift, *(x for x in after[: self.ahead - 1] if x not in self.followed)])
            self.ahead = min(4 * self.ahead, 256)
        found = self.followed[shift]
        return [_Run(p, p + k, x, x + k, k) for p, x, k in zip(*(x.tolist() for x in found), strict=True)] if found else []

    def _follow(self, shifts: list[int]) -> None:
        every = np.arange(len(self.at))
        some = [every if self.buckets is None else self._around(x // LEAST)[0] for x in shifts]
        fit = max(1, int(np.searchsorted(np.cumsum([len(x) for x in some]), PLACES, "right")))
        shifts, some = shifts[:fit], some[:fit]
        of = np.repeat(np.arange(fit), [len(x) for x in some])
        some, order = np.concatenate(some), self.there.order
        at, lo, hi = self.at[some], self.lo[some], self.hi[some]
        want = at + np.array(shifts)[of]
        next_ = np.searchsorted(self.there.places, self.rank[some] + np.clip(want, 0, len(order) - 1))
        after, before = order[np.clip(next_, lo, hi - 1)], order[np.clip(next_ - 1, lo, hi - 1)]
        q = np.where(np.abs(after - want) <= np.abs(before - want), after, before)
        near = np.abs(q - want) <= LEAST
        at, q, of = at[near], q[near], of[near]
        new = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] != 1) | (q[1:] - q[:-1] != 1) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, np.int64)
        first, there, of, size = at[new], q[new], of[new], np.diff(np.r_[new, len(at)])
        able = _joinable(first, there, size, of, self.size) if len(new) else of
        a, b = np.searchsorted(of, np.arange(fit)), np.searchsorted(of, np.arange(fit), "right")
        self.followed |= dict.fromkeys(shifts)
        for i in np.unique(able).tolist():
            self.followed[shifts[i]] = first[a[i] : b[i]], there[a[i] : b[i]], size[a[i] : b[i]]


def _joinable(first: np.ndarray, there: np.ndarray, size: np.ndarray, of: np.ndarray, length: int) -> np.ndarray:
    """The lists ``of`` runs in a text of ``length`` of which some neighbours may be joined to a passage. With m shingles in common
    and gaps of g between them on both sides together, m >= SIMILARITY * (m + g); where the other text goes back, nothing is joined."""
    step, total = there[1:] - there[:-1] - size[:-1], int(size.sum())
    gap = np.where((step < 0) | (of[1:] != of[:-1]), total + 1, step + first[1:] - first[:-1] - size[:-1])
    have = np.cumsum(size)
    rest = have - np.r_[0, np.cumsum(gap)] * (SIMILARITY / (1 - SIMILARITY))
    least = np.minimum.accumulate(rest - size)
    start = first + of * (length + LEAST + 1)
    i = np.searchsorted(start, start + size - LEAST, "right") - 1
    return of[(i >= 0) & (rest - least[np.maximum(i, 0)] >= -0.5)]


def _dense(at: np.ndarray, size: int, least: int) -> bool:
    """Whether some ``least`` or more neighbours of ``size`` places have a share of ``SIMILARITY`` of them in ``at``. A passage
    that is similar enough has so many places in common on either side, as each side is as long as what is in common."""
    if len(at) < SIMILARITY * least or size < least:
        return False
    more = np.full(size + 1, -SIMILARITY)
    more[0] = 0
    more[at + 1] = 1 - SIMILARITY
    more = np.cumsum(more)
    return bool((more[least:] - np.minimum.accumulate(more[: size + 1 - least])).max() >= -1e-6)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers first, first + 1, ... first + count - 1 of each row: (index of the row, number)."""
    r = np.repeat(np.arange(len(count)), count)
    return r, first[r] + np.arange(len(r)) - (np.cumsum(count) - count)[r]


def _joined_passages(runs: list[_Run], text: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The runs joined as far as they can be similar enough, and of these the passages that are."""
    stack: list[_Run] = []
    for run in runs:
        stack.append(run)
        while len(stack) > 1 and (both := stack[-2].joined(stack[-1])):
            stack[-2:] = [both]
    out = []
    while stack:
        r = stack.pop()
        if r.b - r.a < LEAST:
            continue
        one, two = set(text[r.a : r.b].tolist()), set(other[r.x : r.y].tolist())
        like = len(one & two) / len(one | two)
        if like >= SIMILARITY:
            out.append((r.a, r.b, r.x, r.y, like))
        else:
            stack.extend(r.parts)
    return out


def similar_passages(text: np.ndarray, other: np.ndarray | _Ranked, same: bool) -> list[tuple[int, int, int, int, float]]:
    """Passages of ``text`` (shingle hashes) that are similar to one of ``other``: (first, end, first there, end there,
    Jaccard similarity of the sets of shingles). With ``same``, only an earlier place of the one text counts.

    Where shingles have several places in ``other``, every place of each stretch of ``UNBROKEN`` shingles is followed,
    but for stretches of which all around is in found passages already."""
    ranked = other if isinstance(other, _Ranked) else _Ranked(other)
    other = ranked.shingles
    out = _joined_passages(_common_runs(text, ranked, same), text, other)
    if not ranked.repeats or len(text) < LEAST:
        return out
    first = np.minimum(np.searchsorted(ranked.ranked, text), len(other) - 1)
    second = np.minimum(first + 1, len(other) - 1)
    match, several = ranked.ranked[first] == text, (ranked.ranked[second] == text) & (second > first)
    if same:
        match &= ranked.order[first] < np.arange(len(text))
        several &= ranked.order[second] < np.arange(len(text))
    if not (match & several).any() or not _dense(np.flatnonzero(match), len(text), LEAST):
        return out
    covered = np.zeros(len(text), bool)
    for a, b, *_ in out:
        covered[a:b] = True
    stretches, order = ranked.stretches
    own = _stretches(text)
    lo, hi = np.searchsorted(stretches, own), np.searchsorted(stretches, own, "right")
    # The matches around each stretch, first to last.
    starts, at = np.flatnonzero(hi > lo), np.flatnonzero(match)
    first, last = np.searchsorted(at, starts - LEAST), np.searchsorted(at, starts + UNBROKEN + LEAST) - 1
    starts, first, last = (x[last >= first] for x in (starts, first, last))
    first, last = at[first], at[last] + 1

    def open_(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        left = np.r_[0, np.cumsum(~covered)]
        return np.flatnonzero(left[last] > left[first])

    some = open_(first, last)
    if not len(some):
        return out
    near, seen, count = _Near(text, ranked, same), set(), (hi - lo)[starts[some]]
    for some in np.split(some, np.flatnonzero(np.diff(np.cumsum(count) // PLACES)) + 1):
        some = some[open_(first[some], last[some])]
        r, k = _ranges(lo[starts[some]], (hi - lo)[starts[some]])
        shift, around = order[k] - starts[some[r]], some[r]
        follow = near.enough(shift) & (not same or shift < 0)
        shift, around = shift[follow], around[follow]
        done, found = 0, True
        while found:
            left = done + open_(first[around[done:]], last[around[done:]])
            found = False
            new = left[np.sort(np.unique(shift[left], return_index=True)[1])]
            new = new[[s not in seen for s in shift[new].tolist()]] if len(new) else new
            shifts = shift[new].tolist()
            for n, (i, s) in enumerate(zip(new.tolist(), shifts, strict=True)):
                seen.add(s)
                for x in _joined_passages(near.runs(s, shifts[n + 1 : n + near.ahead]), text, other):
                    if not covered[x[0] : x[1]].all():
                        out.append(x)
                        covered[x[0] : x[1]] = found = True
                if found:
                    done = i + 1
                    break
    return out


def _values(m: str) -> list[Column]:
    """The sketch values of a place."""
    return [F.shiftright(f"{m}.{side}", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) for side in ("sketch", "sketch_after") for k in range(SKETCHES)]


def _agree(a: str, b: str) -> Column:
    """Whether any of the sketch values of two places agrees."""
    out = F.lit(False)
    for x, y in zip(_values(a), _values(b), strict=True):
        out = out | (x == y)
    return out


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Compare the texts of pairs (doc, tag, pdoc, ptag, at: the places c with their groups): rows of kind 1 are similar
    passages (first, end, pfirst, pend, similarity), rows of kind 0 the places (c) in none of them."""
    some = pairs.select("doc", "tag").unionByName(pairs.select(F.col("pdoc").alias("doc"), F.col("ptag").alias("tag"))).distinct()
    texts = only(docs, cut(some), ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    both = pairs.join(texts, ["doc", "tag"]).join(texts.select(F.col("doc").alias("pdoc"), F.col("tag").alias("ptag"), F.col("text").alias("ptext")), ["pdoc", "ptag"])
    schema = "kind int, doc long, tag int, pdoc long, ptag int, first int, end int, pfirst int, pend int, similarity double, c int, grp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
        for batch in batches:
            for part in (x for y in pieces(batch, "text") for x in pieces(y, "ptext")):
                h, at, _, _ = text_shingles(*string_offsets(part.column(5)))
                # The rows are joined by the other text last, so few different ones stand in a piece.
                known = {k: i for i, k in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))}
                number = {k: n for n, k in enumerate(known)}
                ph, pat, _, _ = text_shingles(*string_offsets(part.column(6).take(pa.array(list(known.values())))))
                ranked = [_Ranked(ph[a:b]) for a, b in zip(pat, pat[1:], strict=False)]
                rows = []
                for i, (doc, tag, pdoc, ptag, places) in enumerate(zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)):
                    own = (doc, tag) == (pdoc, ptag)
                    found = similar_passages(h[at[i] : at[i + 1]], ranked[number[pdoc, ptag]], own)
                    rows += [(1, doc, tag, pdoc, ptag, *f, None, None) for f in found]
                    rows += [
                        (0, doc, tag, pdoc, ptag, None, None, None, None, None, x["c"], x["grp"])
                        for x in places if not any(a <= x["c"] < b for a, b, *_ in found)
                    ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return both.select("doc", "tag", "pdoc", "ptag", "at", "text", "ptext").mapInArrow(run, schema)


def _similar(docs: DataFrame) -> DataFrame:
    """Later passages with an earlier similar one: (doc, tag, first, end, pdoc, ptag, pfirst, pend, similarity), in
    shingles, for rows (doc, tag, text); earlier means a smaller (doc, tag) or place."""
    # The keys alone first: the join then has plain shuffles on both sides, of which hot keys are split.
    keys = stored(_keys(docs).groupBy("key").count().where("count > 1").select("key"))
    shared = stored(_windows(docs).join(keys, "key", "left_semi"))
    discard(keys)
    c, reach = F.floor(F.col("place") / (_REACH * _REACH)).cast("int"), (F.col("place") % (_REACH * _REACH)).cast("int")
    shared = shared.withColumns({"c": c, "reach": reach})
    classes = stored(shared.groupBy("key", "content", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "c", "sketch", "sketch_after")).alias("m")))
    before, after = F.floor(F.col("reach") / _REACH).cast("int"), F.col("reach") % _REACH
    out = (
        shared.join(classes.where("n > 1").select("key", "content", "reach", "m"), ["key", "content", "reach"])
        .where((F.col("doc") != F.col("m.doc")) | (F.col("tag") != F.col("m.tag")) | (F.col("c") != F.col("m.c")))
        .select(
            "doc", "tag", (F.col("c") - before).alias("first"), (F.col("c") + after + 1).alias("end"), F.col("m.doc").alias("pdoc"), F.col("m.tag").alias("ptag"),
            (F.col("m.c") - before).alias("pfirst"), (F.col("m.c") + after + 1).alias("pend"), F.lit(1.0).alias("similarity"),
        )
    )
    # Texts that may repeat themselves.
    twice = shared.groupBy("doc", "tag", "key").count().where("count > 1").select("doc", "tag").distinct()
    none = F.array().cast("array<struct<c: int, grp: bigint>>")
    alone = twice.select("doc", "tag", F.col("doc").alias("pdoc"), F.col("tag").alias("ptag"), none.alias("at"))
    out = out.unionByName(stored(_verify(stored(alone), docs)).where("kind = 1").select(out.columns))
    left = classes.select(F.col("key").alias("grp"), "m")
    at_once = max(1, docs.count() // 4)
    old: list[DataFrame] = []
    while True:
        pivots = left.groupBy("grp").agg(F.min("m").alias("p"), F.max("m").alias("top")).where("p != top").select("grp", "p")
        faced = stored(left.join(pivots, "grp").where("m != p").select("grp", "p", "m"))
        if faced.isEmpty():
            return out
        # Other places of the first one's own text are dealt anew as they are: that text was compared with itself above.
        like = _agree("m", "p") & ((F.col("m.doc") != F.col("p.doc")) | (F.col("m.tag") != F.col("p.tag")))
        pairs = stored(
            faced.where(like)
            .select("m.doc", "m.tag", F.col("p.doc").alias("pdoc"), F.col("p.tag").alias("ptag"), F.struct(F.col("m.c").alias("c"), "grp").alias("x"))
            .groupBy("doc", "tag", "pdoc", "ptag")
            .agg(F.collect_set("x").alias("at"))
        )
        # The texts of the pairs are shuffled: in passes of at most a quarter as many pairs as there are texts.
        passes, missed = -(-pairs.count() // at_once), None
        for k in range(passes):
            part = pairs.where(F.pmod(F.xxhash64("doc", "tag", "pdoc", "ptag"), F.lit(passes)) == k)
            checked = stored(_verify(part, docs))
            out = out.unionByName(checked.where("kind = 1").select(out.columns))
            these = checked.where("kind = 0").select("grp", "doc", "tag", "c")
            missed = these if missed is None else missed.unionByName(these)
        rest = faced.where(~like)
        if missed is not None:
            at = (faced.grp == missed.grp) & (F.col("m.doc") == missed.doc) & (F.col("m.tag") == missed.tag) & (F.col("m.c") == missed.c)
            rest = rest.unionByName(faced.where(like).join(missed, at, "left_semi"))
        rest = stored(rest)
        # Dealt anew by every sketch value that the first of the group does not have. Rows that are alone in their new group have no
        # partner any more; of groups with the same rows, as several values of one side make them, one stays.
        values = [F.when(a != b, F.xxhash64("grp", F.lit(k), a)) for k, (a, b) in enumerate(zip(_values("m"), _values("p"), strict=True))]
        new = F.explode(F.array_compact(F.array(*values))).alias("grp")
        hashed = rest.select(new, F.xxhash64("m", F.lit(0)).alias("x"), F.xxhash64("m", F.lit(1)).alias("y"))
        several = hashed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("n > 1")
        several = stored(several.groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp"))
        left = stored(only(rest.select(new, "m"), several, ["grp"]))
        discard(faced, pairs, rest, several, *old)
        old = [left]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, n_words, source_ids, similarity): the passages, of 50 words or more, that are similar
    to an earlier one (smaller doc_id, or earlier in the same text): Jaccard similarity of 5-word shingles of 0.8 or more.

    Overlapping passages of a document are one; ``source_ids`` are the documents with the earlier ones,
    ``similarity`` the least of them. Null, empty and shorter texts have none. Rows that repeat an id and a text count
    once; a null id is less than all others. The words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0."""
    rows = _keyed(docs)
    return _merge(_similar(rows)).select(
        given_id(F.col("doc")).alias("doc_id"), "first_word", "end_word",
        (F.col("end_word") - F.col("first_word")).alias("n_words"), "source_ids", "similarity",
    )


def _merge(found: DataFrame) -> DataFrame:
    """(doc, tag, first_word, end_word, source_ids, similarity): overlapping passages of a text as one."""
    spans = found.groupBy("doc", "tag", "first", "end").agg(
        F.collect_set(given_id(F.col("pdoc"))).alias("of"), F.min("similarity").alias("s")
    )
    lists = spans.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("first", "end", "of", "s"))).alias("all"))

    # A passage begins where no earlier one reaches. The list is as long as one text at most.
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), F.array_union(last["of"], x["of"]).alias("of"), F.least(last["s"], x["s"]).alias("s")
        )
        return F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] + SHINGLE - 1 >= x["first"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(acc, F.array(x)))

    none = F.slice("all", 1, 0)
    merged = lists.select("doc", "tag", F.explode(F.aggregate("all", none, step)).alias("x"))
    return merged.select(
        "doc", "tag", F.col("x.first").cast("long").alias("first_word"), (F.col("x.end") + SHINGLE - 1).cast("long").alias("end_word"),
        F.sort_array("x.of").alias("source_ids"), F.round("x.s", 6).alias("similarity"),
    )


def remove_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the passages that ``repeated_passages`` names: from the passage's first word up to
    the word after it. All columns stay; ``n_chars``, if there is one, is the new text's. A row may be left with an
    empty text; rows that repeat an id and a text are cut alike."""
    keyed = _keyed(docs, F.struct(*docs.columns).alias("row"))
    spans = _merge(_similar(keyed.select("doc", "tag", "text")))
    spans = spans.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("at"))
    joined = keyed.join(spans, ["doc", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = string_offsets(part.column(1))
                start, _, before = word_bounds(data, off)
                out = []
                for i, at in enumerate(part.column(2).to_pylist()):
                    edges = [int(off[i])]
                    for x in at:
                        a, b = int(before[i]) + x["first_word"], int(before[i]) + x["end_word"]
                        edges += [int(start[a]), int(start[b]) if b < before[i + 1] else int(off[i + 1])]
                    edges.append(int(off[i + 1]))
                    out.append(b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["row", "text"])

    kind = keyed.schema["row"].dataType.simpleString()
    changed = joined.where("at is not null").select("row", "text", "at").mapInArrow(run, f"row {kind}, text string")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    cols = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.where("at is null").select("row.*").unionByName(changed.select(cols))

"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point is mapped to a class by a table; the
automaton of the split pattern is then a sequence of transition functions, one per code point.
They are composed by an associative scan (doubling). Most functions are constant: only an
apostrophe and the letters behind it depend on the state before, so only they take part in the
doubling. The states say where tokens start, and the slices feed a cache of merged pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import per_worker, pieces, small_batches

#: Entries of the piece cache of a worker; it starts anew when full (results do not change).
CACHE_SIZE = 250_000

# Classes of code points. L: letter, N: number, P: any other non-blank, W: white space but U+0020, B: U+0020.
L, N, P, W, B = range(5)

# States after a code point: its class, or, near an apostrophe, A: an apostrophe that starts a token,
# Q: A and then l, V: A and then v or r, C: a whole contraction.
A, Q, V, C = range(5, 9)
UNKNOWN = 255

# Symbols 0-4 are the classes and lead to the state of that name. The others depend on the state
# before: the apostrophe, and behind an apostrophe the letters of contractions.
MARK, ENDS, ELL, VEE, EE = range(5, 10)
_STEP = np.tile(np.array([L, N, P, W, B, A, L, L, L, L], np.uint8)[:, None], (1, 9))
_STEP[MARK, [P, A, B]] = P
_STEP[ENDS, A] = C
_STEP[ELL, [A, Q]] = [Q, C]
_STEP[VEE, A] = V
_STEP[EE, V] = C


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def code_classes() -> np.ndarray:
    """Class of each code point, by Unicode category and the white space of the split pattern."""
    table = np.full(sys.maxunicode + 1, P, np.uint8)
    kinds = {"L": L, "N": N}
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k in kinds:
            table[c] = kinds[k]
    # Unicode property White_Space (fixed values).
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = W
    table[0x20] = B
    return table


def scan(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """State after each symbol: an associative scan of the symbols' transition functions.

    Constant functions are known at once. The others hold a link to the symbol before the stretch
    that they cover; a step reads the state there, or composes with the function there and takes
    its link, so a stretch doubles each time. ``head`` marks first symbols, before which it is W.
    """
    state = np.where(symbols < MARK, symbols, UNKNOWN).astype(np.uint8)
    todo = np.flatnonzero(symbols >= MARK)
    step = _STEP[symbols[todo]]
    link = np.where(head[todo], -1, todo - 1)
    while len(todo):
        known = np.where(link < 0, W, state[link])
        ready = known != UNKNOWN
        state[todo[ready]] = step[ready, known[ready]]
        todo, step, link = todo[~ready], step[~ready], link[~ready]
        open_ = state[link] == UNKNOWN
        k = np.searchsorted(todo, link[open_])
        step[open_], link[open_] = np.take_along_axis(step[open_], step[k], axis=1), link[k]
    return state


def token_starts(points: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each code point, whether a match of the split pattern starts there.

    ``points``: code points of several texts one after the other; ``off``: their n + 1 offsets.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = table[points]
    head = np.zeros(n, bool)
    head[off[:-1][np.diff(off) > 0]] = True
    final = np.r_[head[1:], True]
    symbols = cls.copy()
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        near = np.unique(np.minimum(np.r_[mark + 1, mark + 2], n - 1))
        for letters, symbol in (("stmd", ENDS), ("l", ELL), ("vr", VEE), ("e", EE)):
            symbols[near[np.isin(points[near], [ord(c) for c in letters])]] = symbol
        symbols[mark] = MARK
    state = scan(symbols, head)
    before = np.r_[np.uint8(W), state[:-1]]
    before[head] = W
    # after[c, s]: a code point of class c starts a token behind state s (blanks: below).
    after = np.ones((5, 9), bool)
    after[L, [L, B, Q, V]] = after[N, [N, B]] = after[P, [P, A, B]] = False
    start = after[cls, before]
    start[state == C] = False
    pending = np.flatnonzero(((state == Q) | (state == V)) & ~final)
    start[pending] = state[pending + 1] != C
    # A run of blanks is one token, but its last one is apart if a non-blank follows.
    blank = cls >= W
    start[blank] = ((before < W) | (before > B))[blank] | (~final & np.r_[~blank[1:], False])[blank]
    return start | head


class Merger(dict):
    """Piece to token ids; a missing piece is merged by rank and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else merge(raw, self.ranks)
        if len(self) >= CACHE_SIZE:
            self.clear()
        if len(raw) <= 64:
            self[piece] = ids
        return ids


def merge(raw: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the pair of lowest rank, the leftmost of equals, until no pair has a rank.

    Short pieces rescan their pairs; others use a heap over a linked list of parts, so a very long
    piece takes n log n steps. Both give the same ids.
    """
    n = len(raw)
    if n <= 24:
        none = len(ranks) + 1
        parts = [raw[i : i + 1] for i in range(n)]
        order = [ranks.get(raw[i : i + 2], none) for i in range(n - 1)]
        while order and (low := min(order)) < none:
            i = order.index(low)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                order[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[x] for x in parts)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        m = end[a]
        if not m or m >= n or m >= b or end[m] != b:
            continue
        end[a], end[m] = b, 0
        if b < n:
            prev[b] = a
            if (r := ranks.get(raw[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
        p = prev[a]
        if p >= 0 and (r := ranks.get(raw[p:b])) is not None:
            heapq.heappush(heap, (r, p, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = end[i]
    return tuple(out)


def _sent(spark, path: str):
    """The ranks for every task, with a digest of them: a worker keeps what it makes of them under that name."""
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks))


def _tools(sent):
    name, ranks = sent.value
    classes = per_worker("bpe_classes", code_classes)
    return classes, *per_worker(f"bpe_{name}", lambda: (Merger(ranks), np.array([len(t) for t in _vocabulary(ranks)], np.int64)))


def _vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, starts]): token ids of each whole text as little-endian unsigned 32-bit
    integers in a binary column; with ``offsets``, also the first byte of each token (64-bit).

    Null text: no tokens. Repeated rows give a row each. No special tokens: their strings are
    ordinary text. ``path`` names a rank file; its size bounds what is broadcast."""
    ranks = _sent(small_batches(docs).sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, merged, sizes = _tools(ranks)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [x or "" for x in part.column(1).to_pylist()]
                off = np.cumsum([0, *map(len, texts)])
                all_text = "".join(texts)
                points = np.frombuffer(all_text.encode("utf-32-le"), np.uint32)
                at = np.flatnonzero(token_starts(points, off, table))
                ends = np.r_[at, len(points)][1:].tolist()
                lists = [merged[all_text[a:b]] for a, b in zip(at.tolist(), ends, strict=True)]
                row_of = np.searchsorted(at, off).tolist()
                ids, count, starts = [], [], []
                for a, b in zip(row_of, row_of[1:], strict=False):
                    own = np.fromiter(chain.from_iterable(lists[a:b]), "<u4")
                    ids.append(own.tobytes())
                    count.append(len(own))
                    if offsets:
                        starts.append((np.cumsum(sizes[own]) - sizes[own]).astype("<i8").tobytes())
                cols = [part.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if offsets:
                    cols, names = [*cols, pa.array(starts, pa.binary())], [*names, "starts"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids binary" + ", starts binary" * offsets
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes of each row's ids. Null ids: empty."""
    ranks = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = ranks.value
        vocabulary = per_worker(f"bpe_vocabulary_{name}", lambda: _vocabulary(own))
        for batch in batches:
            for part in pieces(batch, "ids"):
                out = [
                    b"".join(map(vocabulary.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                    for x in part.column(2).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids; SHA-256 of both as hex."""
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

"""Language identification by mixture inference.

Each language has a distribution over hashed character trigrams, counted over all training texts.
A text is a mixture of languages: expectation-maximisation estimates its proportions from the
trigram likelihoods. The set of languages is chosen by penalised likelihood (BIC): languages are added
in the order of their share as long as the fit gains more than the penalty. The prediction is
the language with the largest share.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import per_worker, pieces, small_batches

#: Hash buckets of character trigrams.
BUCKETS = 1 << 14
#: Steps of expectation-maximisation for each fit: a fixed number, so that a text's result does not depend on its batch.
STEPS = 12
#: A language with no more of the full mixture than this is not tried beside others: its share is below what these steps settle.
LEAST_SHARE = 0.02
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Code point to its lower-case letter; everything else becomes a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigram_counts(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct trigram buckets of each text, and whether it has a letter.
    A run of characters that are no letters counts as one space; every text begins and ends with one."""
    joined = " ".join(["", *texts, ""])
    points = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    off = np.cumsum([1, *(len(x) + 1 for x in texts)])  # first code point of each text; the one before is a space
    row = np.repeat(np.arange(-1, len(texts)), np.diff(np.r_[0, off]))
    row = np.r_[row, np.full(len(points) - len(row), len(texts))]
    keep = ~((points == 32) & np.r_[False, points[:-1] == 32] & np.r_[False, row[1:] == row[:-1]])
    points, row = points[keep], row[keep]
    letter = np.bincount(row[points != 32] if len(row) else row, minlength=len(texts))[: len(texts)] > 0
    a, b, c = points[:-2].astype(np.uint64), points[1:-1].astype(np.uint64), points[2:].astype(np.uint64)
    with np.errstate(over="ignore"):
        h = ((a * np.uint64(0x1F35B) + b) * np.uint64(0x2545F) + c) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (h >> np.uint64(64 - 14)).astype(np.int64)
    owner = row[1:-1]
    ok = (owner >= 0) & (owner < len(texts)) & (points[1:-1] != 32)
    key, count = np.unique(owner[ok] * BUCKETS + bucket[ok], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count.astype(np.float64), letter


def mixture(row: np.ndarray, prob: np.ndarray, count: np.ndarray, n: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once: proportions (n, k) and log likelihood per text.

    ``row``: text of each trigram, ascending; ``prob`` (trigrams, k): its probability in each language."""
    k = prob.shape[1]
    share = np.full((n, k), 1.0 / k)
    total = np.bincount(row, count, n)
    loglik = np.zeros(n)
    for step in range(steps + 1):
        joint = prob * share[row]
        norm = joint.sum(axis=1)
        if step == steps:
            loglik = np.bincount(row, count * np.log(norm), n)
            break
        weight = count / norm
        share = np.stack([np.bincount(row, joint[:, j] * weight, n) for j in range(k)], axis=1) / np.maximum(total, 1)[:, None]
        share = np.maximum(share, 1e-12)
    return share, loglik


def choose(row: np.ndarray, prob: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Proportions (n, k) over the set of languages with the best penalised likelihood; zero outside it. Languages are tried in
    the order of their share in the full mixture, those above ``LEAST_SHARE``; of equal ones the first in the alphabet leads."""
    k = prob.shape[1]
    total = np.bincount(row, count, n)
    single = np.stack([np.bincount(row, count * np.log(prob[:, j]), n) for j in range(k)], axis=1)
    full, _ = mixture(row, prob, count, n)
    order = np.argsort(-full, axis=1, kind="stable")
    best_one = single.argmax(axis=1)
    best = np.zeros((n, k))
    best[np.arange(n), best_one] = 1.0
    score = single[np.arange(n), best_one]
    open_ = (k > 1) & (full[np.arange(n), order[:, min(1, k - 1)]] > LEAST_SHARE)  # texts with a second language worth a fit
    for size in range(2, k + 1):
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        use = np.zeros((n, k), bool)
        np.put_along_axis(use, order[:, :size], True, axis=1)
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        mine = place[row] >= 0
        r = place[row[mine]]
        share, loglik = mixture(r, np.where(use[row[mine]], prob[mine], 1e-12), count[mine], len(todo))
        value = loglik - 0.5 * (size - 1) * np.log(np.maximum(total[todo], 2))
        better = value > score[todo]
        best[todo[better]] = np.where(use[todo[better]], share[better], 0.0)
        score[todo[better]] = value[better]
        open_[todo[~better]] = False
        if size < k:
            open_ &= full[np.arange(n), order[:, size]] > LEAST_SHARE
    return best


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (languages, ``BUCKETS``), from every row with a text and a
    language. Tasks send one count vector per language; its length is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker("langid_letters", _letters)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                lang = part.column(1).to_pylist()
                row, bucket, count, _ = trigram_counts(part.column(0).to_pylist(), table)
                names = sorted(set(lang))
                code = np.array([names.index(x) for x in lang], np.int64)
                for j, name in enumerate(names):
                    own = code[row] == j
                    sums.setdefault(name, np.zeros(BUCKETS))
                    sums[name] += np.bincount(bucket[own], count[own], BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").collect()
    counts = np.zeros((len(found), BUCKETS))
    for i, r in enumerate(found):
        for b, n in r.c:
            counts[i, b] = n
    smooth = counts + 0.5
    return [r.lang for r in found], smooth / smooth.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) of every row: the language with the largest share, that
    share, and the chosen languages with their shares, largest first (of equal shares the first in the alphabet). Without a letter (or text, or a
    model) the prediction is ``und`` with score 0. Repeated rows give a row each."""
    held = docs.sparkSession.sparkContext.broadcast((languages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker("langid_letters", _letters)
        names, prob = held.value
        by_bucket = np.ascontiguousarray(prob.T)
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                row, bucket, count, letter = trigram_counts([x or "" for x in part.column(1).to_pylist()], table)
                share = choose(row, by_bucket[bucket], count, n) if names else np.zeros((n, 0))
                pred, score, langs, shares = [], [], [], []
                for i in range(n):
                    order = [int(j) for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0] if letter[i] else []
                    pred.append(names[order[0]] if order else UNDETERMINED)
                    score.append(min(1.0, float(share[i, order[0]])) if order else 0.0)
                    langs.append([names[j] for j in order])
                    shares.append([float(share[i, j]) for j in order])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    ["doc_id", "lang_pred", "score", "languages", "shares"],
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def held_out(doc_id) -> F.Column:
    """Whether a row belongs to the part that is never trained on. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict all: (doc_id, held_out, lang_pred, score, languages, shares)."""
    languages, model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = identify(docs, languages, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")

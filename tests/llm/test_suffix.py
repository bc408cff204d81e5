import hashlib
import random
from collections import Counter

import pytest

from matricula.llm import suffix


def _brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _check(spark, texts, length, window=128):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lo string")
    rows = suffix.remove_repeats(df, length, window).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    want = _brute(texts, length)
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, got[i], w)


def test_documents_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    _check(spark, texts, 400)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_splices_match_brute_force(spark, seed):
    """Passages that begin, end and overlap anywhere, with different partners along one text."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(60, 400))) for _ in range(6)]
    texts = []
    for _ in range(50):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) // 2)
            t += p[a : a + rnd.randint(20, len(p))] + "".join(rnd.choice("xyz") for _ in range(rnd.choice([0, 0, 1, 50])))
        texts.append(t)
    _check(spark, texts, 80, 32)
    _check(spark, texts, 80, 64)


def test_runs_and_edge_rows(spark):
    texts = [None, "", "a" * 1000, "a" * 399, "b" * 400, "ab" * 600, "é" * 500, "short", "b" * 400, "c" * 400 + "d", "c" * 399 + "e"]
    _check(spark, texts, 400)


def test_repeated_rows_and_ids(spark):
    t = "".join(random.Random(4).choice("abcdefgh ") for _ in range(900))
    rows = [(1, t), (1, t), (2, "x" + t[:399]), (None, t[:450]), (3, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.digests(df).collect())
    assert got == [(0, 450, 450), (1, 900, 900), (1, 900, 900), (2, 400, 0), (3, 4, 0)]
    assert suffix.digests(df.limit(0)).count() == 0

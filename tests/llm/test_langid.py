import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matricula.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    own = [r for r in got if r.held_out]
    assert 150 < len(own) < 350
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = langid.train(docs)
    by = {r.lang: r.text for r in docs.where(F.length("text").between(2000, 4000)).orderBy("doc_id").collect()}
    mixed = by["en"][:1800] + " " + by["de"][:900]
    df = spark.createDataFrame([(1, mixed), (2, by["en"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, languages, model).collect()}
    assert got[1].languages[:2] == ["en", "de"] and 0.5 < got[1].score < 0.8
    assert got[2].languages == ["en"] and got[2].score == 1.0


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat", None), (None, "the cat", "en"), (4, "the cat", None), (5, "the dog " * 30000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.predict_languages(df).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.predict_languages(df.limit(0)).count() == 0
    unlabelled = langid.predict_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def _plain_em(prob, count, use, steps=langid.STEPS):
    share = [1 / len(prob[0])] * len(prob[0])
    prob = [[p if j in use else 1e-12 for j, p in enumerate(x)] for x in prob]
    for _ in range(steps):
        new = [0.0] * len(share)
        for p, c in zip(prob, count):
            norm = sum(a * b for a, b in zip(p, share))
            for j in range(len(share)):
                new[j] += c * p[j] * share[j] / norm
        share = [max(x / sum(count), 1e-12) for x in new]
    return share, sum(c * math.log(sum(a * b for a, b in zip(p, share))) for p, c in zip(prob, count))


def test_mixtures_and_sets_against_a_plain_fit():
    """The batch's fits and choices of languages against one text at a time, in plain Python."""
    rng = np.random.default_rng(3)
    k, texts = 4, []
    for _ in range(40):
        m = int(rng.integers(1, 60))
        shares = rng.dirichlet([0.4] * k)
        base = rng.dirichlet([0.3] * 30, size=k)
        at = rng.choice(30, m, p=shares @ base / (shares @ base).sum())
        bucket, count = np.unique(at, return_counts=True)
        texts.append((np.maximum(base[:, bucket].T, 1e-9), count.astype(float)))
    row = np.repeat(np.arange(len(texts)), [len(c) for _, c in texts])
    prob, count = np.concatenate([p for p, _ in texts]), np.concatenate([c for _, c in texts])
    share, loglik = langid.mixture(row, prob, count, len(texts))
    best = langid.choose(row, prob, count, len(texts))
    several = 0
    for i, (p, c) in enumerate(texts):
        full, ll = _plain_em(p.tolist(), c.tolist(), range(k))
        assert np.allclose(share[i], full, atol=1e-9) and abs(loglik[i] - ll) < 1e-6
        order = sorted(range(k), key=lambda j: -share[i, j])
        one = max(range(k), key=lambda j: (c * np.log(p[:, j])).sum())
        score, want = (c * np.log(p[:, one])).sum(), {one: 1.0}
        for size in range(2, k + 1):
            if share[i, order[size - 1]] <= langid.LEAST_SHARE:
                break
            fit, ll = _plain_em(p.tolist(), c.tolist(), order[:size])
            value = ll - 0.5 * (size - 1) * math.log(max(c.sum(), 2))
            if value <= score:
                break
            score, want = value, {j: fit[j] for j in order[:size]}
        several += len(want) > 1
        assert {j: best[i, j] for j in range(k) if best[i, j] > 0} == pytest.approx(want, abs=1e-6)
    assert several > 3

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from matricula.llm import resampling as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def marks(text, buckets):
    w = words(text)
    return [zlib.crc32(x) % buckets for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]


def brute(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    s, t = (Counter(b for text in texts for b in marks(text, buckets)) for texts in ([d[1] for d in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, text in docs:
        m = marks(text, buckets)
        weight = sum(map(gain, m)) // len(m) if m else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(m), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o, d in zip(out, docs) if len(words(d[1])) >= least), key=lambda o: (-o[3], o[0] is None, o[0]))
    for rank, o in enumerate(able[: len(able) * percent // 100], 1):
        o[4] = rank
    return sorted(map(tuple, out), key=str)


def found(spark, docs, target, **more):
    df = R.importance_resampling(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(x,) for x in target], "text string"), **more)
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(n, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["Data", "model", "train", "café", "Ünïcode", "x1", "tok", "naïve", "语言", "seed", "long" * 30]
    return [(i, rnd.choice([" ", ", ", "_", "\n"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(n)]


def test_against_brute_force(spark):
    docs, target = texts(300), [x for _, x in texts(20, 8)]
    got = found(spark, docs, target)
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 40
    assert found(spark, docs, target, buckets=7, percent=100, least_words=0) == brute(docs, target, 100, 0, buckets=7)


def test_odd_rows(spark):
    same = " ".join(["again"] * 30)
    docs = [
        *texts(40), (None, None), (100, None), (101, ""), (102, "\x00 ... \n"), (103, same), (103, same), (103, "other " + same), (None, same), (104, "a" * 300_000),
        (105, "word " * 50_000),
    ]
    target = [same, None, ""]
    assert found(spark, docs, target, percent=60) == brute(docs, target, 60)
    assert found(spark, [], target) == []
    assert found(spark, texts(30), []) == brute(texts(30), [])


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame(texts(60), DOCS).withColumns({c: F.lit("x") for c in ("rank", "score", "weight", "row", "tie", "high", "segment", "part")})
    got = R.importance_resampling(df, spark.createDataFrame([("tok",)], "text string").withColumn("n", F.lit(1)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(texts(60), ["tok"])


def test_ranks_by_regular_sampling(spark):
    # One score and one id hold most rows; every number of ways gives the same order.
    rows = [(i % 7 if i % 3 else 1, i % 5 if i % 2 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long")
    want = sorted((-s, i) for i, s in rows)
    for ways in (1, 2, 7, 40):
        got = sorted(R.ranked(df, ways).collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 3001))
        assert [(-r.score, r.doc_id) for r in got] == want


def test_segments_are_even(spark):
    n, ways = 20_000, 16
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.hash("id") % 1000).cast("long").alias("score"))
    got = R.ranked(df, ways).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(got) == ways and max(r["count"] for r in got) <= 2 * n / ways + ways


def test_crc_from_any_register():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.choice([0, 1, 3, 9, 64, 65, 700], 300)
    first = rng.integers(0, 1 << 32, 300, np.uint32)
    got = R.crc_onwards(data, start, end, first)
    want = [zlib.crc32(data[a:b].tobytes(), int(f) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for a, b, f in zip(start, end, first)]
    assert got.tolist() == want

import math
import random

import numpy as np
from pyspark.sql import functions as F

from matricula.llm import negatives as N

VECTORS = "vec_id long, embedding array<float>, label int"
EVERY = "vec_id % 10 = 0"


def brute(rows, step=10, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows]
    out = set()
    for a, va, ya in rows:
        if a % step:
            continue
        dot = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in rows if i != a]
        for p, pid, _ in sorted(d for d in dot if d[2] == ya)[:positives]:
            p = -p
            far = sorted(d for d in dot if d[2] != ya and 30 * p <= -100 * d[0] <= 90 * p)[:negatives]
            out |= {(a, pid, r, i, p, -s) for r, (s, i, _) in enumerate(far, 1)}
    return out


def found(spark, rows, **more):
    got = [tuple(r) for r in N.hard_negatives(spark.createDataFrame(rows, VECTORS), more.pop("anchor", EVERY), **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def cases(n, dims, wide=1.0, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0.1, wide) for _ in range(dims)], rnd.choice([0, 0, 0, 1, 2])) for i in range(n)]
    return [(i, rows[i % 90][1] if i % 3 == 0 else v, y) for i, v, y in rows]  # copies: equal scores


def test_against_brute_force(spark):
    for n, dims, wide in ((400, 16, 0.2), (150, 5, 3.0), (1500, 8, 0.1)):
        rows = cases(n, dims, wide)
        want = brute(rows)
        assert want and found(spark, rows) == want


def test_stripes_give_the_same_rows(spark):
    rows = cases(600, 16, 0.2)
    assert found(spark, rows, stripe_bytes=300) == brute(rows)


def test_planes_and_lookups_are_exact():
    rng = np.random.default_rng(1)
    for low, high in ((-300, 300), (0, 1), (-1, 0), (-(1 << 40), 1 << 40)):
        q = rng.integers(low, high, (50, 24), endpoint=True)
        planes = int(np.where(q < 0, ~q, q).max()).bit_length() + 1
        packed = N.bit_planes(q, planes)
        assert (N.from_planes(packed) == q).all()
        assert (N.scores(N.subset_sums(q[:7], planes), packed) == q @ q[:7].T).all()


def test_percentages_round_as_asked():
    p = np.array([-101, -100, -1, 0, 1, 33, 99, 100, 101, 1 << 60])
    assert N.part_of(p, 90, False).tolist() == [math.floor(x * 90 / 100) if abs(x) < 1000 else x * 90 // 100 for x in p.tolist()]
    assert N.part_of(p, 30, True).tolist() == [-((-x * 30) // 100) for x in p.tolist()]


def test_odd_rows(spark):
    good = cases(120, 4, 0.3)
    odd = [
        (None, [0.1] * 4, 0), (500, None, 0), (510, [0.1, None, 0.2, 0.3], 0), (520, [float("nan"), 0.1, 0.1, 0.1], 1), (530, [float("inf"), 0.1, 0.1, 0.1], 1),
        (540, [0.1] * 4, None),
    ]
    short = [(600, [0.5], 0), (601, [], 1)]  # count as filled with zeros
    twice = [good[3], good[20], (20, [9.0] * 4, 9)]  # repeated rows, and another row under an id
    want = brute(good + [(600, [0.5, 0, 0, 0], 0), (601, [0.0] * 4, 1)])
    assert found(spark, good + odd + short + twice) == want
    clashing = spark.createDataFrame(good, VECTORS).withColumns({c: F.lit("x") for c in ("rank", "score", "planes", "a", "anchor_id", "stripe")})
    assert {tuple(r) for r in N.hard_negatives(clashing, EVERY).collect()} == brute(good)


def test_huge_and_zero_components(spark):
    rows = [(i, [0.0] * 3, i % 2) for i in range(12)]  # a positive score of 0 allows 0 only
    assert found(spark, rows) == brute(rows)
    assert N.hard_negatives(spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0), (2, [1e-30], 1)], VECTORS), EVERY).count() >= 0


def test_empty_and_no_anchor(spark):
    assert found(spark, []) == set()
    assert found(spark, cases(50, 4), anchor="vec_id < 0") == set()
    assert N.hard_negatives(spark.createDataFrame([], VECTORS), EVERY).columns == [c.split()[0] for c in N.RESULT.split(", ")]


def test_query_matches_its_sql(spark, sf):
    import duckdb

    from matricula.llm.catalogo import op13_hard_negatives

    got = op13_hard_negatives(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    rel = con.sql(f"select {', '.join(got.columns)} from ({N.ORACLE_SQL})")
    want = set(rel.fetchall())
    assert want and {tuple(r) for r in got.collect()} == want

import random

import numpy as np
import xxhash

from matricula.llm import simhash


def _fingerprint(text):
    s = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        s = s.replace(c, " ")
    w = [x for x in s.split(" ") if x]
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps, bits):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    comp = _components(want, 4)
    got = simhash.simhash_near_dedup(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.fingerprint == f"{want[r.doc_id]:016x}"
        assert r.component_id == comp[r.doc_id]


def test_links_of_random_fingerprints(spark):
    rnd = random.Random(3)
    fps, n = {}, 0
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps[n] = x
            n += 1
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in fps.items()]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(fps, 4)


def test_dense_group_links_without_all_pairs(spark):
    """Fingerprints that differ from one another by up to 8 bits form one component."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {i: base ^ sum(1 << b for b in rnd.sample(range(12), rnd.randint(0, 4))) for i in range(400)}
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in fps.items()]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == _components(fps, 4)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one", "x"), (5, long, "x"), (5, long, "x"), (None, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_near_dedup(df).collect()
    assert len(got) == 7
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {1, 2, 3} and all(r.component_id == 1 for r in got if r.doc_id in zero)
    assert [r.component_id for r in got if r.doc_id is None] == [4]
    empty = simhash.simhash_near_dedup(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]

import random

import numpy as np

from matricula.llm import decontam


def _smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_scores():
    rnd = random.Random(1)
    for _ in range(60):
        a = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))], np.uint64)
        b = np.array([rnd.randint(0, 5) for _ in range(rnd.randint(1, 20))], np.uint64)
        score, lo, hi = decontam.align(a, b)
        assert score == _smith_waterman(a, b)
        assert _smith_waterman(a, b[lo:hi]) == score


def _world(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: words(30) for i in range(20)}
    docs, want = {}, set()
    for d in range(200):
        text = words(rnd.randint(5, 150))
        if d % 4 == 0:
            i = rnd.randrange(20)
            copy = list(items[i])
            if d % 8 == 0:  # edited: words changed, dropped and added
                for _ in range(3):
                    copy[rnd.randrange(len(copy))] = "changed"
                del copy[rnd.randrange(len(copy))]
                copy.insert(rnd.randrange(len(copy)), "added")
            at = rnd.randint(0, len(text))
            text[at:at] = copy
            want.add((d, i))
        docs[d] = " ".join(text)
    return items, docs, want


def test_finds_planted_copies(spark):
    items, docs, want = _world(3)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in items.items()], "item_id long, text string")
    one = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in one} == want
    brute = {(d, i): _smith_waterman(w, docs[d].split()) / 60 for d in list(docs)[:40] for i, w in items.items()}
    assert {k for k, v in brute.items() if v >= 0.5} == {k for k in want if k[0] < 40}
    for r in one:
        if (r.doc_id, r.item_id) in brute:
            assert abs(brute[r.doc_id, r.item_id] - r.score) < 1e-9
    many = decontam.contaminated(df, bench, block_words=100).collect()  # several blocks, the same result
    assert sorted(map(tuple, many)) == sorted(map(tuple, one))


def test_every_edited_copy_is_found(spark):
    """Copies with every third, fourth or fifth word changed, with a word put in after each, with words dropped or changed here and
    there, beside texts of the items' common words: the same as aligning every item with every document."""
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(15)]
    items = {i: [rnd.choice(common) if rnd.random() < 0.4 else f"t{rnd.randrange(5000)}" for _ in range(n)] for i, n in enumerate([1, 2, 3, 5, 8, 11, 20, 20, 35, 50])}
    docs = {}
    for w in items.values():
        for step in (2, 3, 4, 5):
            for k in range(step):
                docs[len(docs)] = ["before"] * rnd.randrange(9) + [x if j % step != k else "changed" for j, x in enumerate(w)] + ["after"]
        docs[len(docs)] = [y for x in w for y in (x, "put")]
        docs[len(docs)] = [y for j, x in enumerate(w) for y in ((x, "put") if j % 2 else (x,))]
        for _ in range(6):
            docs[len(docs)] = [x if rnd.random() > 0.3 else f"new{rnd.randrange(99)}" for x in w if rnd.random() > 0.1]
        docs[len(docs)] = w[::-1]
    for _ in range(60):
        docs[len(docs)] = rnd.choices(common, k=rnd.randrange(60))
    scores = {(d, i): _smith_waterman(w, x) / (2 * len(w)) for d, x in docs.items() for i, w in items.items()}
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for least in (0.5, 0.6, 0.34):
        got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench, least).collect()}
        want = {k: v for k, v in scores.items() if v >= least}
        assert got == want and len(want) > 80
    thirds = [["t" + str(j) if j % 3 else "x" for j in range(n)] for n in (11, 20, 35, 50)]  # scores of 0.52 to 0.6
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(thirds)], "doc_id long, text string")
    bench = spark.createDataFrame([(len(x), " ".join("t" + str(j) for j in range(len(x)))) for x in thirds], "item_id long, text string")
    assert {(d, len(x)) for d, x in enumerate(thirds)} <= {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}


def test_repeated_words_in_item_and_text(spark):
    """An item of equal words against a long text of them: one region, one alignment."""
    df = spark.createDataFrame([(1, "na " * 20_000), (2, "na " * 99 + "x"), (3, "x na " * 300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "na " * 200), (2, "na na na")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 2): 1.0, (3, 1): 201 / 400, (3, 2): 4 / 6}


def test_seeds_are_the_rarest_places():
    item, count = np.arange(6, dtype=np.uint64), np.array([5, 0, 9, 1, 9, 2])
    place, needed = decontam.seeds(item, count, 0.5)
    assert sorted(place.tolist()) == [0, 1, 3, 5] and needed == 1
    assert [x.tolist() if n == 0 else x for n, x in enumerate(decontam.seeds(item, count, 1.0))] == [[1], 1]
    place, needed = decontam.seeds(np.arange(40, dtype=np.uint64), np.arange(40), 0.5)
    assert len(place) == 25 and needed == 5 and len(decontam.seeds(item[:1], count[:1], 0.5)[0]) == 1


def test_hot_item_keeps_its_seeds(spark):
    items, docs, _ = _world(5)
    rows = [(d, t + " " + " ".join(items[0])) for d, t in docs.items()]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("item_id = 0")
    assert got.count() == len(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (4, "x " * 50000 + "alpha beta gamma delta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha, beta!"), (2, None), (3, " "), (None, "x"), (5, "alpha beta gamma delta")], "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    # Two of the four words of item 5 in place score 0.5.
    assert sorted((r.doc_id, r.item_id) for r in got) == [(3, 1), (3, 1), (3, 5), (3, 5), (4, 1), (4, 5)]
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0

import random
from collections import defaultdict

import numpy as np

from matricula.llm import substring
from matricula.llm.base import Rolling


def _words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_compact_windows_are_the_cartesian_tree():
    rnd = random.Random(1)
    for _ in range(40):
        rows = [[rnd.randint(0, 1 << 62) for _ in range(rnd.randint(0, 60))] for _ in range(4)]
        t = rnd.randint(2, 12)
        want = set()

        def node(r, a, b, base):
            if b - a < t:
                return
            c = min(range(a, b), key=lambda i: (rows[r][i] >> 28, i))
            want.add((r, base + a, base + c, base + b - 1))
            node(r, a, c, base)
            node(r, c + 1, b, base)

        at = np.cumsum([0, *map(len, rows)])
        for r in range(4):
            node(r, 0, len(rows[r]), int(at[r]))
        h = np.array([x for r in rows for x in r], np.uint64)
        if len(h) >= t:
            assert set(zip(*(x.tolist() for x in substring.compact_windows(h, at, t)), strict=True)) == want


def _shingles(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return substring.text_shingles(raw, np.array([0, len(raw)]))[0]


def _covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.first_word, r.end_word))
    return out


def _world(seed=5):
    """Documents of random words with passages in common: exact, edited (one word in about 25) and in a hot group that
    shares a line; and what must not be found."""
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    line = words(9)
    passages = [words(rnd.randint(55, 120)) for _ in range(8)]
    texts, exact, edited, clean = {}, set(), set(), set()
    for d in range(160):
        w = words(rnd.randint(30, 200))
        w[len(w) // 2 : len(w) // 2] = line
        kind = d % 4
        if kind in (1, 2):
            p = list(passages[rnd.randrange(8)])
            if kind == 2:
                for _ in range(len(p) // 25):
                    p[rnd.randrange(len(p))] = "edited"
            at = rnd.randint(0, len(w))
            w[at:at] = p
            (exact if kind == 1 else edited).add(d)
        else:
            clean.add(d)
        texts[d] = " ".join(w)
    return texts, exact, edited, clean


def test_planted_passages(spark):
    texts, exact, edited, clean = _world()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = substring.repeated_passages(df).collect()
    found, named = {r.doc_id for r in rows}, {s for r in rows for s in r.source_ids}
    assert not (found | named) & clean
    assert exact <= found | named
    # Against all pairs of texts, compared in full.
    h = {d: _shingles(t) for d, t in texts.items()}
    brute = defaultdict(set)
    for d in texts:
        for e in range(d):
            for a, b, *_ in substring.similar_passages(h[d], h[e], False):
                brute[d].update(range(a, b + 4))
    mine = _covered(rows)
    later = {d for d in brute if brute[d]}
    assert len(later & set(mine)) >= 0.9 * len(later)  # candidates are found with a probability; exact repeats always
    hit = sum(len(brute[d] & mine[d]) for d in brute)
    assert hit >= 0.9 * sum(map(len, brute.values()))
    assert set(mine) <= {d for d in brute if brute[d]}


def test_every_repeat_of_fifty_words_in_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: _words(r.text or "") for r in docs.collect()}
    mine = _covered(substring.repeated_passages(docs).collect())
    first = {}
    for d in sorted(texts):
        w = texts[d]
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if k in first:
                assert set(range(i, i + 50)) <= mine[d], (d, i, first[k])
            else:
                first[k] = (d, i)
    kept = {r.doc_id: _words(r.text) for r in substring.remove_passages(docs).collect()}
    assert set(kept) == set(texts)
    for d, w in texts.items():
        assert kept[d] == [x for i, x in enumerate(w) if i not in mine[d]]


def test_repeats_of_fifty_words_in_texts_of_repeated_lines(spark):
    """Passages whose shingles also stand elsewhere in their own texts: every place of a text is compared."""
    rnd = random.Random(6)
    words = lambda n: [f"z{rnd.randint(0, 99999)}" for _ in range(n)]
    texts, later = {}, {}
    for d in range(0, 120, 2):
        lines = [words(rnd.randint(10, 14)) for _ in range(7)]
        passage = [w for k in range(5) for w in lines[k]]
        alone = lambda: [w for k in rnd.sample(range(7), 7) for w in words(6) + lines[k]]  # noqa: E731, B023
        texts[d] = alone() + alone() + words(5) + passage + words(5) + alone()
        texts[d + 1] = alone() + words(5)
        later[d + 1] = range(len(texts[d + 1]), len(texts[d + 1]) + len(passage))
        texts[d + 1] += passage + words(5) + alone()
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    mine = _covered(substring.repeated_passages(df).collect())
    assert [d for d, at in later.items() if not set(at) <= mine[d]] == []


def test_least_passages_with_one_changed_word_meet(spark):
    """50 words of which one is changed share a key, and the sketches do not keep the two texts apart."""
    rnd = random.Random(8)
    words = lambda n: [f"u{rnd.randint(0, 9999999)}" for _ in range(n)]
    texts, pairs = {}, 500
    for d in range(pairs):
        p = words(50)
        texts[2 * d] = words(60) + p + words(60)
        p[rnd.randint(5, 44)] = "changed"
        texts[2 * d + 1] = words(60) + p + words(60)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    found = {r.doc_id for r in substring.repeated_passages(df).collect()}
    assert len(found) >= 0.985 * pairs


def test_similarity_of_passages():
    rnd = random.Random(2)
    a = [f"x{rnd.randint(0, 9999)}" for _ in range(80)]
    b = list(a)
    b[40] = "other"
    (x,) = substring.similar_passages(_shingles(" ".join(b)), _shingles("pre fix " + " ".join(a)), False)
    assert x[:4] == (0, 76, 2, 78) and abs(x[4] - 71 / 81) < 1e-9
    far = [w if i % 8 else "changed" for i, w in enumerate(a)]
    assert substring.similar_passages(_shingles(" ".join(far)), _shingles(" ".join(a)), False) == []


def _repeats_of_fifty(text, other, same=False):
    """Words of ``text`` in 50 words that also stand in ``other`` (``same``: earlier in it), by brute force."""
    out = set()
    for i in range(len(text) - 49):
        if any(text[i : i + 50] == other[j : j + 50] for j in range(min(i, len(other)) if same else len(other) - 49)):
            out.update(range(i, i + 50))
    return out


def test_every_place_of_a_repeated_start_is_followed():
    """The start of a passage also stands earlier in the other text, or its lines come again and again."""
    rnd = random.Random(4)
    words = lambda n: [f"y{rnd.randint(0, 99999)}" for _ in range(n)]
    cases = []
    for size, lead in ((60, 25), (80, 40), (90, 48), (200, 40), (60, 59), (50, 30)):
        p = words(size)
        cases.append((words(20) + p + words(20), words(10) + p[:lead] + words(30) + p + words(10)))
        cases.append((words(20) + p + words(20), words(10) + p[-lead:] + words(30) + p + words(10) + p[5 : 5 + lead]))
    for _ in range(30):
        lines = [words(rnd.randint(6, 20)) for _ in range(5)]
        pick = lambda n: [w for _ in range(n) for w in (rnd.choice(lines) if rnd.random() < 0.9 else words(4))]
        cases.append((pick(20), pick(20)))
    for text, other in cases:
        for same in (False, True):
            there = text if same else other
            want = _repeats_of_fifty(text, there, same)
            found = substring.similar_passages(_shingles(" ".join(text)), _shingles(" ".join(there)), same)
            got = {i for a, b, *_ in found for i in range(a, b + 4)}
            assert want <= got
            for a, b, x, y, like in found:
                one, two = set(zip(*(text[a + k : b + k] for k in range(5)))), set(zip(*(there[x + k : y + k] for k in range(5))))  # noqa: B905
                assert b - a >= substring.LEAST and abs(len(one & two) / len(one | two) - like) < 1e-9 and like >= 0.8
    p = words(80)  # an edited copy behind a repeat of its start
    edited = p[:30] + ["other"] + p[31:]
    found = substring.similar_passages(_shingles(" ".join(edited)), _shingles(" ".join(p[:28] + words(40) + p)), False)
    assert (0, 76, 68, 144) in {x[:4] for x in found}


def test_few_alignments_of_runs_of_one_word_are_tried(monkeypatch):
    """Texts that repeat single words have hundreds of alignments; those that cannot make up a passage are not followed."""
    rnd, calls, own = random.Random(9), [], substring._joined_passages
    words = lambda n: [f"t{rnd.randint(0, 99999)}" for _ in range(n)]
    monkeypatch.setattr(substring, "_joined_passages", lambda *a: (calls.append(1) if a[0] else None) or own(*a))
    spam = lambda n: [w for k in range(6) for w in words(30) + [f"spam{k}"] * n]
    assert substring.similar_passages(_shingles(" ".join(spam(30))), _shingles(" ".join(spam(36))), False) == []
    assert len(calls) <= 2
    p = words(60)
    found = substring.similar_passages(_shingles(" ".join(spam(30) + p + spam(30))), _shingles(" ".join(spam(36) + p[:40] + spam(36) + p)), False)
    assert set(range(360, 416)) <= {i for a, b, *_ in found for i in range(a, b)}


def test_alignments_of_short_runs_are_not_joined(monkeypatch):
    """Texts of two words have a place near to any shift for almost every shingle, but in runs too short to be joined."""
    rnd, calls, own = random.Random(11), [], substring._joined_passages
    monkeypatch.setattr(substring, "_joined_passages", lambda *a: (calls.append(1) if a[0] else None) or own(*a))
    line = [f"l{i}" for i in range(24)]
    mixed = lambda: [w for _ in range(8) for w in [rnd.choice("xy") for _ in range(40)] + line]
    assert substring.similar_passages(_shingles(" ".join(mixed())), _shingles(" ".join(mixed())), False) == []
    assert len(calls) <= 5
    p = [f"p{i}" for i in range(60)]
    found = substring.similar_passages(_shingles(" ".join(mixed() + p + mixed())), _shingles(" ".join(mixed() + p[:40] + mixed() + p)), False)
    assert set(range(512, 568)) <= {i for a, b, *_ in found for i in range(a, b)}


def test_groups_with_the_same_rows_are_dealt_once(spark, monkeypatch):
    groups, own = [], substring.stored

    def stored(df):
        out = own(df)
        if out.columns == ["grp", "m"]:
            rows = defaultdict(set)
            for r in out.collect():
                rows[r.grp].add(r.m)
            groups.append([frozenset(x) for x in rows.values()])
        return out

    monkeypatch.setattr(substring, "stored", stored)
    df = spark.createDataFrame(list(_world()[0].items()), "doc_id long, text string")
    substring.repeated_passages(df).collect()
    assert any(groups) and all(len(set(x)) == len(x) for x in groups)


def test_edge_rows(spark):
    rnd = random.Random(3)
    p = " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(70))
    long = " ".join(f"q{rnd.randint(0, 99999)}" for _ in range(40000))
    rows = [(1, None), (2, ""), (3, "few words"), (4, p), (5, "x y " + p), (5, "x y " + p), (None, p + " end"), (6, long), (7, p + " a b c " + p), (8, "na " * 300)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, n_chars long, tag string")
    got = substring.repeated_passages(df).collect()
    by = {(r.doc_id, r.first_word): r for r in got}
    assert set(by) == {(4, 0), (5, 2), (7, 0), (7, 73), (8, 1)} and by[5, 2].end_word == 72
    kept = substring.remove_passages(df).collect()
    assert len(kept) == len(rows) and substring.remove_passages(df).columns == df.columns
    out = {r.doc_id: r for r in kept}
    assert out[5].text == "x y " and out[5].n_chars == 4 and out[None].text == p + " end" and out[1].text is None and out[6].text == long
    assert _words(out[7].text) == ["a", "b", "c"]
    assert substring.repeated_passages(df.limit(0)).count() == 0 and substring.remove_passages(df.limit(0)).count() == 0


def test_seeds_give_independent_hashes():
    data = np.frombuffer(b"some bytes here", np.uint8)
    a, b = (Rolling(data, s).of(np.array([0, 5]), np.array([4, 9])) for s in (0, 1))
    assert len({*a.tolist(), *b.tolist()}) == 4

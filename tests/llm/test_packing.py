import json
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matricula.llm import packing as P
from matricula.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def laid(runs):
    """(sequence, offset, length) of every piece of a plan."""
    return [(first + i // each, offset + i % each * s, s) for s, _, n, first, each, offset in runs for i in range(n)]


def check_places(places, capacity):
    by = defaultdict(list)
    for q, offset, s in places:
        by[q].append((offset, s))
    for own in by.values():
        end = 0
        for offset, s in sorted(own):
            assert offset == end  # no gap, no overlap
            end += s
        assert end <= capacity
    return len(by)


def least_sequences(items, capacity):
    """Exact, by search over the longest piece's companions (small cases)."""
    best = [len(items)]

    def search(left, used):
        if used + -(-sum(left) // capacity) >= best[0]:
            return
        if not left:
            best[0] = used
            return
        head, rest = left[0], left[1:]
        seen = set()
        for k in range(len(rest), -1, -1):
            for chosen in combinations(range(len(rest)), k):
                group = tuple(rest[i] for i in chosen)
                if group in seen or head + sum(group) > capacity:
                    continue
                seen.add(group)
                search([x for i, x in enumerate(rest) if i not in chosen], used + 1)

    search(sorted(items, reverse=True), 0)
    return best[0]


def test_fixed_sets_never_cost_a_sequence():
    rnd = random.Random(4)
    fixed_some = 0
    for _ in range(250):
        capacity = rnd.choice([10, 17, 30])
        items = [rnd.randint(max(1, capacity // 6), capacity) for _ in range(rnd.randint(1, 8))]
        left = P.Lengths(Counter(items))
        for s in left.order[::-1]:
            if fixed := P.dominant(left, s, capacity):
                fixed_some += 1
                rest = list((Counter(items) - Counter(fixed)).elements())
                assert sum(fixed) <= capacity and not Counter(fixed) - Counter(items)
                assert least_sequences(rest, capacity) + 1 == least_sequences(items, capacity)
    assert fixed_some > 200


def test_plans_are_whole_and_tight():
    rnd = random.Random(6)
    for _ in range(150):
        capacity = rnd.choice([7, 64, 500])
        count = Counter(rnd.choice([rnd.randint(1, capacity), capacity // 2, 1]) for _ in range(rnd.randint(0, 400)))
        runs = P.plan(dict(count), capacity)
        places = laid(runs)
        assert Counter(s for _, _, s in places) == count
        for s in count:  # numbers of a length run from 0 without gaps
            own = sorted((r[1], r[2]) for r in runs if r[0] == s)
            assert [a for a, _ in own] == list(np.cumsum([0, *[n for _, n in own]]))[:-1]
        n = check_places(places, capacity)
        assert n <= 11 / 9 * -(-sum(s * k for s, k in count.items()) // capacity) + 1 or n <= sum(k for s, k in count.items() if s > capacity // 3)
        assert len(runs) <= 8 * len(count) + 8  # bounded by the lengths, not the pieces


def test_small_plans_near_the_least():
    rnd = random.Random(9)
    for _ in range(60):
        items = [rnd.randint(2, 20) for _ in range(8)]
        n = check_places(laid(P.plan(dict(Counter(items)), 20)), 20)
        assert n <= least_sequences(items, 20) + 1


def test_large_counts_stay_short():
    count = {s: 10**9 for s in range(1, 4097)}
    runs = P.plan(count)
    assert sum(r[2] for r in runs) == 4096 * 10**9 and len(runs) < 40_000
    ends = max(first + -(-n // each) for _, _, n, first, each, _ in runs)
    assert ends <= 1.001 * sum(s * n for s, n in count.items()) / 4096


def brute_pieces(docs, capacity):
    t, out = tokenizer(), []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a : a + capacity]
            out.append((i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "\x1c", "a\x1fb c　d\x85e\xa0f​g᠎h", "don't DON'T we're 'twas x'S", "é ́x İstanbul ΣΑΣ ﬁ Ⅻ", "123 4,5.6 \U0001f600\U0001f468‍\U0001f469 语言模型",
    "<|endoftext|> a<|startoftext|>b", "x" * 3000, "ab " * 9000, "word\r\n\r\n\tword word",
]


def test_pieces_equal_the_library(spark):
    rnd = random.Random(3)
    alphabet = [*"abcXYZ019 '.,-\n\t", "é", "ß", "İ", "Σ", "́", "ͅ", "ᅡ", "가", "ᄀ", "‍", "\x1d", "\x85", " ", "中", "٣", "²", "'s", "'LL", "<|endoftext|>", "﻿", " "]
    docs = [*enumerate(ODD), *[(100 + i, "".join(rnd.choices(alphabet, k=rnd.randint(1, 80)))) for i in range(400)], (None, "no id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("ids", "length", "piece", "sequence_id", "offset")})
    got = P.packed_documents(df, PATH, capacity=256).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == brute_pieces(docs, 256)
    assert check_places([(r.sequence_id, r.offset, r.length) for r in got], 256) >= sum(r.length for r in got) / 256


def test_query_on_the_table(spark, sf):
    from matricula.llm.catalogo import op12_best_fit_packing

    got = op12_best_fit_packing(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r[:5]) for r in got), key=str) == brute_pieces(docs, 4096)
    n = check_places([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert n <= -(-sum(r.length for r in got) // 4096) + 1


def test_pack_other_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 11), (4, 10), (5, 4), (5, 4), (6, 6)], "pack_part int, length int").withColumnRenamed("pack_part", "x")
    got = {(r.x, r.length, r.sequence_id is None) for r in P.pack(df.withColumn("offset", F.lit("o")), 10).collect()}
    assert got == {(1, None, True), (2, 0, True), (3, 11, True), (4, 10, False), (5, 4, False), (6, 6, False)}
    assert P.pack(df.where("x > 9"), 10).count() == 0


def test_other_tokenizers_are_refused():
    for key, value in (("normalizer", None), ("post_processor", {"type": "x"}), ("model", {"type": "WordPiece"})):
        d = json.loads(open(PATH).read())
        d[key] = value
        with pytest.raises((ValueError, KeyError)):
            wordbpe.checked(json.dumps(d))


def test_encoder_equals_the_library_on_random_texts():
    e, rnd = wordbpe.WordBpe(open(PATH).read()), random.Random(12)
    common = [*"abcdefghij ABC'.,!-019\n\t", "'s", "'LL", "'re", "'", "the", "ing", "<|endoftext|>", "<|startoftext|>x"]
    rare = [chr(c) for c in [*range(0x80, 0x250), *range(0x300, 0x340), 0x345, 0x3A3, 0x3C2, 0x130, 0x131, 0x1E9E, 0x212A, 0x2160, 0xB2, 0x663, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, 0x2003,
                             0x200B, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x10400, 0x1D400, 0xE0100]]
    texts = ["".join(rnd.choices(common if k % 2 else common + rare, k=rnd.randint(0, 120))) for k in range(4000)]
    texts += ["a" * n + " " + "b" * n for n in range(1, 140)] + ["!" * n for n in range(1, 140)] + ["'" * n + "s" for n in range(5)]
    texts += ["".join(rnd.choices("abcdef", k=n)) for n in range(1, 80) for _ in range(5)]
    for a in range(0, len(texts), 700):
        part = texts[a : a + 700]
        want = [x.ids for x in e.library.encode_batch_fast(part, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(part)] == want
    assert e.encode([]) == []


def test_equal_words_with_equal_hashes(monkeypatch):
    data = np.frombuffer(b"ab cd ab abcdefghij abcdefghik x", np.uint8)
    start, end = np.array([0, 3, 6, 9, 20, 31]), np.array([2, 5, 8, 19, 30, 32])
    for hashed in (wordbpe.mix, lambda x: x * np.uint64(0)):  # the second puts all words of a length under one hash
        monkeypatch.setattr(wordbpe, "mix", hashed)
        one, which = wordbpe.equal_words(data, start, end)
        words = [data[a:b].tobytes() for a, b in zip(start, end)]
        assert [words[i] for i in one[which]] == words

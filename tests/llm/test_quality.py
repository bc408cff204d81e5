import random
import re
from collections import Counter

from matricula.llm import quality

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n)


def test_counts_and_verdicts_on_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in _COUNTS) == _base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.rule == 0)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.kept}


def test_counts_on_odd_texts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a b a b a b", "x\x0by\x0cz\rq\xa0r é ü #*$%&|<>", "l 1\nl 1\n \n\nl 1\nl 2", "w " * 30000]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, stats int, row int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_rules(df, none).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in _COUNTS) == _base(texts[r.doc_id]), texts[r.doc_id]
    assert quality.keep_good(df, none).columns == df.columns
    assert quality.quality_rules(df.limit(0), none).count() == 0


def test_repeated_and_null_ids(spark):
    good = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, good), (1, good), (1, good), (1, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 0), (1, 1), (1, None)], "doc_id long, quality int")
    assert sorted(r.kept for r in quality.quality_rules(df, labels).collect()) == [False, True, True, True]
    assert quality.keep_good(df, labels).count() == 3


def _rows(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        f = {k: rnd.random() for k in quality.FEATURES}
        bad = f["symbol_rate"] > 0.8 or (f["dup_line_rate"] > 0.6 and f["repeat_rate"] > 0.5)
        rows.append((i, f, int(bad)))
    kind = "struct<" + ",".join(f"{k}: double" for k in quality.FEATURES) + ">"
    return spark.createDataFrame(rows, f"doc_id long, features {kind}, bad int")


def test_learns_planted_rules(spark):
    rows = _rows(spark)
    rules = quality.learn(rows)
    used = {c.feature for r in rules for c in r.conditions}
    assert {"symbol_rate", "dup_line_rate", "repeat_rate"} <= used
    judged = rows.withColumn("rule", quality.verdict(rules, "features")).collect()
    assert sum((r.rule > 0) == bool(r.bad) for r in judged) >= 0.97 * len(judged)
    for r in judged:  # the expression is the ordered list
        first = next((i for i, x in enumerate(rules, 1) if all((r.features[c.feature] > c.threshold) == c.above for c in x.conditions)), 0)
        assert r.rule == first


def test_no_rules_without_both_classes(spark):
    rows = _rows(spark, 50)
    assert quality.learn(rows.where("bad = 0")) == [] and quality.learn(rows.limit(0)) == []

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from matricula.llm import bpe, decontam, quality, simhash, substring


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(steps, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, *_ in steps] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    for _, _, after in steps[:-1]:
        assert after.columns == columns


def test_each_stage_against_its_input(steps, spark, sf):
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (_, docs, good), (_, _, distinct), (_, _, cut), (_, _, clean), (_, _, last) = steps
    verdicts = quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(good) == ids(verdicts.where("kept"))
    found = simhash.near_duplicates(simhash.fingerprints(good), 4)
    assert ids(distinct) == ids(found.where("doc_id = component_id"))
    assert ids(cut) == ids(distinct)
    spans = {}
    for r in substring.repeated_passages(distinct).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    before = {r.doc_id: r.text for r in distinct.collect()}
    for r in cut.collect():
        words = [w for i, w in enumerate(" ".join(before[r.doc_id].split()).split(" ")) if i not in spans.get(r.doc_id, ())]
        assert r.text.split() == words and r.n_chars == len(r.text)
        assert r.doc_id in spans or r.text == before[r.doc_id]
    leaks = decontam.contaminated(cut, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(clean) == ids(cut) - ids(leaks)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    rows = last.collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(steps, spark, sf):
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(C.run(spark, sf)) == order(steps[-1][2])


def test_benchmark_copies_without_an_id_go(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first().text
    rows = [(1, "clean words here"), (1, f"front {item} end"), (None, f"other {item} end"), (None, "more clean words"), (None, None)]
    left = C.without_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, left), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_stages_on_edge_rows(spark, sf):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (None, good + " x", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x"))
    kept = [r.doc_id for r in C.good_text(spark, df, sf).collect()]
    assert sorted(kept, key=str) == [1, 1, None]
    near = C.near_dedup(spark, df, sf)
    # The row without an id is a near copy of 1; 2 and 3 have no words and are one.
    assert near.columns == df.columns and sorted((r.doc_id for r in near.collect()), key=str) == [1, 2]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, df.limit(0), sf).count() == 0
        assert stage(spark, df, sf).columns == df.columns
    assert C.encode(spark, df, sf).count() == 5


def test_near_copies_are_known_by_id_and_text(spark, sf):
    """Unrelated texts under one id are documents of their own, copies without an id are one, and the smallest id stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (1, b), (5, a), (None, c), (None, c), (9, b), (4, None), (4, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, (r.text or "")[:2]) for r in C.near_dedup(spark, df, sf).collect()), key=str)
    assert got == sorted([(1, "a0"), (1, "b0"), (4, ""), (None, "c0")], key=str)

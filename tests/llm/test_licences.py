import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from matricula.llm import licences

NOTICES = {
    "MIT": ["Released under the MIT License.", "This package is released under the MIT license."],
    "Apache": ["Licensed under the Apache License, Version 2.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0."],
    "CC-BY": ["Licensed under CC BY 4.0."],
}


@pytest.fixture(scope="module")
def found(spark, sf):
    rows = [(100_000 + i, f"A first line.\n{t}\nA last line with permission to stay.") for i, (f, ts) in enumerate(NOTICES.items()) for t in ts[:1]]
    rows += [(200_000, None), (200_001, ""), (None, NOTICES["MIT"][0]), (200_002, "I lost my driving license yesterday\nthe gnu is a large antelope"), (200_003, "x " * 100000)]
    rows += [(200_004, NOTICES["MIT"][1]), (200_004, NOTICES["MIT"][1])]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    return docs, licences.licence_notices(docs, sample=500).collect()


def test_planted_notices(found):
    got = {(r.doc_id, r.paragraph): r for r in found[1]}
    for i, family in enumerate(NOTICES):
        r = got[100_000 + i, 1]
        assert r.family == family and r.confirmed and r.similarity == 1.0
        assert (100_000 + i, 0) not in got and (100_000 + i, 2) not in got
    assert [r.family for r in found[1] if r.doc_id is None] == ["MIT"]
    assert [r.family for r in found[1] if r.doc_id == 200_004] == ["MIT", "MIT"]
    assert not [r for r in found[1] if r.doc_id in (200_000, 200_001, 200_002, 200_003)]


def test_lines_of_the_documents(found):
    """Every known notice line of the documents is found with its family, and nothing else is."""
    by = {t: f for f, ts in NOTICES.items() for t in ts}
    want = {(r.doc_id, i): by[x] for r in found[0].where("doc_id < 100000").collect() for i, x in enumerate((r.text or "").split("\n")) if x in by}
    assert {(r.doc_id, r.paragraph): r.family for r in found[1] if r.doc_id is not None and r.doc_id < 100_000} == want


def test_every_paragraph_is_scored(spark, sf):
    """The same rows as the model gives over all paragraphs that are not empty, with and without a cue word, but for those
    that are a notice only by words whose hashes collide with a notice's."""
    odd = ["Released under GPLv3.", "CC BY-SA 4.0", "CC BY 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "Dual MIT/Apache-2.0", "", "  "]
    odd += ["any person obtaining a copy of this software and associated documentation files", "Sublicensing and licensors", "Mozilla Public License, v. 2.0"]
    odd += ["to deal in the Software without restriction", "the terms of the GNU Lesser General Public", "Apache-2.0", "BSD 3-Clause"]
    rows = spark.createDataFrame([(900_000 + i, f"{t}\nOther words.") for i, t in enumerate(odd)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(rows).cache()
    model, names, least = licences.train(docs, 500)
    every = licences._score(licences.paragraphs(docs).where("trim(text) != ''"), model, names, 1 << 14)
    every = every.where(f"family != 'unknown' and score >= {least}").select("doc_id", "paragraph", "text", "grams", F.col("family").alias("all"))
    known = licences._with_features(licences._variants(spark), 1 << 14).select(F.explode("grams").alias("g")).distinct()
    known = F.array(*[F.lit(r.g) for r in known.collect()])
    own = HashingTF(inputCol="own", outputCol="vector", numFeatures=1 << 14, binary=True).transform(every.withColumn("own", F.array_intersect("grams", known)))
    rows = model.transform(own).collect()
    want = {(r.doc_id, r.paragraph, r["all"]) for r in rows if r.prediction != 0}
    assert len(rows) - len(want) <= 3
    got = {(r.doc_id, r.paragraph, r.family) for r in licences.licence_notices(docs, 500).collect()}
    assert want <= got <= {(r.doc_id, r.paragraph, r["all"]) for r in rows}
    assert {(900_001, 0, "CC-BY"), (900_002, 0, "CC-BY"), (900_003, 0, "CC-BY-NC")} <= got


def test_empty(spark):
    assert licences.licence_notices(spark.createDataFrame([], "doc_id long, text string"), sample=10).count() == 0


def test_training_takes_all_paragraphs(spark, monkeypatch):
    """No paragraph is left out of training and calibration, however many there are; repeated ones count once."""
    rows = [(i, f"line x{i} of words\nyou need no license x{i} for this\nthe same line\n ") for i in range(9000)]
    rows += [(9000, "Released under the MIT License."), (9001, None)]
    docs, taken, own = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [], licences._ordinary
    monkeypatch.setattr(licences, "_ordinary", lambda df: taken.append(own(df)) or taken[0])
    licences.licence_notices(docs)
    got = {r.cued: r.n for r in taken[0].groupBy("cued").agg(F.sum("n").alias("n")).collect()}
    assert got == {False: 9001, True: 9000}
    assert taken[0].where("n > 4000").count() >= 2

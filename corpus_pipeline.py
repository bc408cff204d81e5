"""Corpus cleaning in stages, each by one operator of ``matricula.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), gets all rows that the
stage before kept, and returns the columns of ``documents`` (the last: token counts and digests).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm import bpe, decontam, quality, simhash, substring
from matricula.llm.base import but_for, only, remove, stored
from matricula.sesion import aplicar_ajustes, asegurar_checkpoint

TOKENIZER = "byte_bpe_50k.tiktoken"


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the rules learned from ``labels`` reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id (null ids last). Rows are known by id and
    text: rows that repeat both count once, rows that share an id only are documents of their own."""
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    keyed = docs.select(key.alias("doc_id"), "text", F.col("doc_id").alias("id"))
    found = simhash.near_duplicates(simhash.fingerprints(keyed, shingle=4), max_bits=4).select(F.col("doc_id").alias("key"), "component_id")
    ids = keyed.select(F.col("doc_id").alias("key"), "id").distinct()
    first = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key"))
    stay = found.distinct().join(ids, "key").groupBy("component_id").agg(first.alias("stays")).select("stays")
    # Only rows that repeat id and text have to meet; the texts of the others stay where they are.
    kept = only(docs.withColumn("__row_key", key), stored(stay.withColumnRenamed("stays", "__row_key")), ["__row_key"])
    twice = stored(docs.select(key.alias("__row_key")).groupBy("__row_key").count().where("count > 1").select("__row_key"))
    again = only(kept, twice, ["__row_key"]).dropDuplicates(["__row_key"])
    return but_for(kept, twice, ["__row_key"]).unionByName(again).select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that are similar to an earlier one are cut out of their texts."""
    return substring.remove_passages(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, with or without an id. Rows that share an id are told apart by their texts."""
    key = F.xxhash64("doc_id", F.col("text").cast("string"))
    found = decontam.contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keys = stored(found.select(F.col("doc_id").alias("__row_key")).distinct())
    return but_for(docs.withColumn("__row_key", key), keys, ["__row_key"]).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded bytes of each document."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", good_text),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", passage_dedup),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encode),
]

#: The learned rules and the text operators have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result but the last is written as Parquet to the shared
    checkpoint folder and read again as the next stage's input."""
    aplicar_ajustes(spark)
    folder = f"{asegurar_checkpoint(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if previous:
                remove(spark, previous)
            previous = path
    return docs

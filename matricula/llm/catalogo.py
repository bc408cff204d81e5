"""Queries of the training-data operators: ``REGISTRO`` (name to callable) and ``ORACULO`` (DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm import bpe, decontam, html, langid, licences, negatives, packing, quality, resampling, simhash, substring, suffix, warc
from matricula.sesion import aplicar_ajustes

TOKENIZER = "byte_bpe_50k.tiktoken"
PACKING_TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    aplicar_ajustes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document that is similar to an earlier one, with the documents that hold those."""
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, by a decision list learned from all rows of ``labels``."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every repeated 400-byte string from every document: sizes, runs and a digest of the rest."""
    return suffix.digests(_table(spark, sf_dir, "documents"), length=400)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a whole or edited copy of a benchmark item, with the item and the place."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record of an archive made from ``pages``, resolved, with its headers as sorted lines."""
    records = warc.records_of_pages(_table(spark, sf_dir, "pages"))
    return warc.resolved_text(warc.resolve_revisits(records))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of ``documents`` that reads as a licence notice, with its family."""
    return licences.licence_notices(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links at 4 or fewer bits."""
    return simhash.simhash_near_dedup(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document: a quarter of them drawn towards the texts of ``benchmark``."""
    return resampling.importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 4096 tokens."""
    return packing.packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER), capacity=4096, end_id=1)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten hard negatives for each of the five nearest positives of every hundredth vector. Where the id is
    divisible by 7, the label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, is_anchor=F.col("vec_id") % 100 == 0)


REGISTRO: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_main_text, op2_substring_dedup, op3_quality_rules, op4_suffix_dedup, op5_benchmark_decontamination, op6_language_id, op7_warc_revisits,
        op8_licences, op9_simhash_near_dedup, op10_byte_bpe, op11_importance_resampling, op12_best_fit_packing, op13_hard_negatives,
    )
}
ORACULO: dict[str, str] = {"op7_warc_revisits": warc.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}

"""The corpus pipeline: quality, exact and near duplicates, mixing, packing. Each stage's rows are the next one's documents.

All stages read every row and the whole text, and treat a null text as empty. Rows whose doc_id is null or repeated are
rows like any other (a null id stands for a group of equal or alike texts only where there is no other); ties go to the least id. Very
long texts are handled whole, an empty table gives an empty result, and extra columns are carried through, whatever
their names; the last stage alone returns columns of its own. Stages keep no state, so they can be composed without writing in
between, and pipelines can run side by side.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm import exact_dedup, mixing, near_dedup, packing, quality
from assay.llm.common import Scope, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in their five-word shingles (Jaccard similarity 0.8 or more) one document stays: SimHash components
    by vantage-point trees and MinHash buckets give candidates, whole sets of shingles decide."""
    return near_dedup.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Hashed models and 64-bit hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again. What a stage wrote
    besides, and the rows before it, are deleted as soon as its own rows are written; other runs' tables are left alone."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scope()
    for _, stage in STAGES[:-1]:
        with Scope() as scope:
            docs = materialize(stage(spark, docs, sf_dir))
        before.delete(spark)
        scope.delete(spark, but=(docs,))
        before = scope
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five stages over ``documents``.

Quality rules, exact dedup, near-dedup, mixing to target weights, packing. Each
stage takes the documents that the one before kept and returns documents again
(all columns), the last one the packed pieces. ``run`` writes each stage's
result as Parquet in the shared folder and reads it back, so lost executors
cost a stage's tasks at most, and drops a stage's scratch tables once its
result is written.

SQL cannot express packing and tokenising, so there is no ORACLE_SQL; the stages
are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmap.llm import exact_dedup, minhash, mixing, packing, quality, scratch

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the suffix-array repetition rules."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", source_mix),
    ("pack", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch.dropped(spark):
            path = f"{scratch.shared_folder(spark)}/stage-{name}-{scratch.unique()}"
            stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            scratch.delete(spark, held)
        docs, held = spark.read.parquet(path), path
    return docs

"""A training corpus from documents: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpmill.llm import exact_dedup, minhash_dedup, mixing, quality, sentence_pieces


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return quality.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; a document that is taken twice is two rows."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix."""
    return sentence_pieces.encode(docs, keep=["doc_id", "source"]).select("doc.doc_id", "doc.source", "n_tokens", "ids", "parity")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mixed), ("sentence_pieces", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: No SQL expresses near-duplicates and token ids; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None

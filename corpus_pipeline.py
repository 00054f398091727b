"""A training corpus from `documents`: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared
folder and rereads it as the next stage's docs. All but the last return the columns of documents, and any others.

Nulls: a null or empty text fails the base rules of the first stage; a null lang or source is a value of its own; a
null doc_id stands alone in the second stage and passes the others. Very long texts are worked on whole. Repeated
rows: of equal texts the smallest doc_id stays, with all rows that repeat it; mixing moves these together. Tables
may be empty, and extra columns may have any name; both are returned as they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, kneser, mixing, near, pieces, pii


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return kneser.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards flat weights, none more than twice as often as another; no row goes."""
    return mixing.mix_rows(docs, max_repeats=2.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", redact_pii),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

# Perplexity models, signatures and segmentation are beyond SQL; tests hold each stage against its operator's brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with common.scratch(spark):  # a stage's own tables go once its result is written
            docs = common.materialize(stage(spark, docs, sf_dir), "stage", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to training sequences: five stages, each over all that the one before kept.

Every stage's rows are written as Parquet to the cluster's shared folder and read again, so a lost executor
costs at most the stage at hand. All stages but the last return the columns of documents; the last returns
one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from admitflow.llm import exact_dedup, jaccard_join, mixing, packing, quality
from admitflow.llm.queries import tokenizer_path
from admitflow.plans.shared import materialise


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.7 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat or shrink to their target shares; a document comes twice at most."""
    return mixing.mix_rows(docs, weights=(3, 1, 2), share=1.5, max_repeat=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=2, capacity=4096)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be written as SQL; tests/llm tests the stages by hand and their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

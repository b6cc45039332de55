"""The corpus pipeline: five stages over ``documents``, each one of the operators in feedmill.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return
the columns of ``documents``.  Empty tables, null texts and repeated rows pass through every stage as the
operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm import bpe, decontaminate, quality, repeats, simhash
from feedmill.session import staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes and more that occur elsewhere, cut at whole characters."""
    found = repeats.remove_repeats(docs, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("NOT contaminated").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the checksum of the text that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks).select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("decontamination", without_benchmarks),
    ("tokens", tokens),
]

#: SQL cannot express the learned classifier; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

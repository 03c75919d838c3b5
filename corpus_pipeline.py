"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; every stage is
written as Parquet and read back. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import exact_stream, minhash, mixing, packing, ppm
from runledger.llm.common import stored
from runledger.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return ppm.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    return exact_stream.drop_copies(docs, plain=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: where each piece of each document lies, with its token ids."""
    return packing.pack_tiers(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: Learned, iterative and tokenizing stages can't be expressed in SQL; tests/llm/test_pipeline.py holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

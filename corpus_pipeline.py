"""Corpus preparation in five stages: quality, near-duplicates, benchmark leaks, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brocade.llm import decontaminate, mixing, quality, simhash, tokens
from brocade.llm.common import settle, shared_path, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated towards the sources' target weights and shuffled; the columns stay those of docs."""
    return mixing.poisson_mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all copies are written in a shuffled order and read back, one row per copy."""
    path = shared_path(spark, "ids")
    # copies of a document differ by nothing: a random number parts them, and texts of one id by their hash
    order = F.md5(F.concat_ws(":", F.lit("encode"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"), F.rand(11).cast("string")))
    tokens.write_ids(docs.select("doc_id", "text"), path, tokens.tokenizer_path(), order=[order], keyless=True)
    return tokens.read_ids(spark, path)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontaminate", keep_clean), ("mix", mix), ("token_ids", encode)]

#: Edit distances, SimHash groups and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs

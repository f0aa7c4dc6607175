"""Clean a corpus and pack it into training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tractloom.functions.stage import materialize
from tractloom.llm import near_copies, op2_quality_rules, op5_packing, op7_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go; the labels beside the documents train the scores."""
    return op7_toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the threshold table go."""
    return op2_quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word similarity of 0.8 or more the document with the smallest id stays."""
    return near_copies.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences."""
    return op5_packing.pack(docs, public_tokenizers.path(op5_packing.VOCABULARY))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Most stages cannot be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

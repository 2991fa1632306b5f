"""Documents through five stages: quality rules, line dedup, near-dedup, benchmark decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and gets the rows that the stage before it wrote.

Null, empty or blank text: rejected by the quality rules, as are all texts of under 50 words. Null doc_id: a document like any
other, but of near copies one with an id stays. Repeated rows and ids: each row is judged by itself; equal texts are near
copies of which one row stays. Very long texts: whole. Empty tables: no rows. Extra columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import op3_decontamination, op5_line_dedup, op8_simhash, op9_quality_rules, op10_sentencepiece
from siltstone.llm.common import give_back, remove, scratch, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def sparing(stage: Stage) -> Stage:
    """The stage, with the driver's freed memory given back before it begins and before its rows are written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        rows = stage(spark, docs, sf_dir)
        give_back(spark)
        return rows

    return run_stage


@sparing
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_quality_rules.filter_documents(docs)


@sparing
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_line_dedup.remove_lines(docs)


@sparing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_simhash.keep_one(docs)


@sparing
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@sparing
def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_sentencepiece.encode_decode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokenization", tokenization)]

#: SQL has neither SimHash's hashing nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written as Parquet to the shared folder and read again; they are removed once the next stage is written, the last stage's when the driver ends."""
    base, before = scratch(spark), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        before = name
    return docs

"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolecall.llm import decontaminate, line_join, near_dup, packing, quality
from rolecall.staging import stage_table

#: Near-dedup of the pipeline: five words, similarity 0.8; four rows a band keep the chance of a miss below one in a million.
NEAR = near_dup.Settings(words=5, similarity=(80, 100), rows=4, bands=28)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, whole; without labels of both kinds it rejects none. Trained on the labelled ones among ``docs``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an equal or similar earlier line makes superfluous."""
    return line_join.dedup_lines(docs, line_join.similar_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates; repeated rows of that doc_id stay together."""
    found = near_dup.near_duplicates(docs, NEAR)
    gone = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    found = stage_table(decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Neither a trained model nor a tokenizer can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

"""A training-corpus pipeline over the documents table: stages that each take and give documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import scope, written
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import keep_quality
from tidemark.llm.simhash_dedup import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged like any others."""
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the smallest doc_id stays; null texts equal empty ones, null ids come last."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, texts without words being one group. The
    operator's contract fixes shingles and radius."""
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; a null source is one of its own."""
    return mixed_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. Each stage's result is a table of its own; what it made on the way is deleted with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return docs

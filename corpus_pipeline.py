"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns a frame; it is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import decontamination, near_dedup, packing, quality, secrets
from kindred.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality and toxic ones."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, 0.8 and more)."""
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with windows of two or more benchmark items, and cuts the spans of one item
    out of the others."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a marker; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: a row for each piece of a document."""
    return packing.pack(docs, ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup_filter),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact),
    ("best-fit packing", pack),
]

#: SQL can't express the fitted classifier, the tokenizer or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs

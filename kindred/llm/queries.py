"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import chat, decontamination, html_text, lm_scoring, near_dedup, nearest, packing, quality, secrets, token_store
from kindred.llm.common import scratch
from kindred.llm.oracle import ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    scores = lm_scoring.score_documents(_read(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))
    return scores.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(_read(spark, sf_dir, "documents"), path)
    return token_store.digests(token_store.read_tokens(spark, path))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(spark, chat.with_probe(_read(spark, sf_dir, "conversations")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.render_pages(_read(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings"), every=20, top=20)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), ids=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_groups(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_store": op3_token_store,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_nearest": op8_nearest,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_near_dedup": op10_near_dedup,
}

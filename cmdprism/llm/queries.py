"""The registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.llm import (
    chat,
    contamination,
    jaccard,
    language,
    licenses,
    merkle,
    mixing,
    pii,
    quality,
    secrets,
    topk,
    toxicity,
    whitening,
)
from cmdprism.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op1(table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(table(spark, sf_dir, "conversations"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op4(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6(table(spark, sf_dir, "documents"))


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.pmod(F.col("id"), F.lit(topk.QUERY_STEP)) == 0
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_personal_data": op3_personal_data,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_quality_grades": op9_quality_grades,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}
ORACLES: dict[str, str] = {
    "op2_chat_snapshots": chat.OP2_SQL,
    "op7_decontamination": contamination.OP7_SQL,
    "op10_exact_top_k": topk.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}

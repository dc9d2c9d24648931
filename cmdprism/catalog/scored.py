"""Scored telemetry: three scorers with fixed weights over the feature table, and its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.catalog.telemetry import telemetry, with_features
from cmdprism.functions.features import build_features
from cmdprism.sources.tables import materialize
from cmdprism.operators.scoring import Provider, linear_provider, score_table, stack_probabilities

WEIGHTS = {
    "keyword": ({"has_certutil": 2.5, "has_encodedcommand": 3.0, "has_cmd": -1.0, "has_reg_add": 0.5}, -1.25),
    "shape": ({"cmd_length": 0.03, "cmd_token_count": -0.2, "cmd_digit_count": 0.01, "cmd_upper_ratio": -0.7}, -0.6),
}
MODELS = ["value", *WEIGHTS]


def providers() -> list[Provider]:
    fixed = [linear_provider(name, *weights) for name, weights in WEIGHTS.items()]
    return [("value", lambda df: df.withColumn("prob_value", F.col("score"))), *fixed]


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_probabilities(build_features(telemetry(spark, sf_dir)), providers())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, row_id, _label, score), scores rounded so that both engines see the same ties."""
    table = score_table(stacked(spark, sf_dir), MODELS)
    return table.select("model", "row_id", "_label", F.round("prob", 6).alias("score"))


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table written once, for queries that read it several times."""
    return materialize(scored(spark, sf_dir), "scores")


def margin_sql(name: str) -> str:
    weights, intercept = WEIGHTS[name]
    terms = " + ".join(f"{column} * {weight!r}e0" for column, weight in weights.items())
    return f"1e0 / (1e0 + exp(-({intercept!r}e0 + {terms})))"


STACKED_SQL = f"""SELECT *, score AS prob_value, {margin_sql('keyword')} AS prob_keyword,
  {margin_sql('shape')} AS prob_shape FROM features"""
SCORED_SQL = """SELECT 'value' AS model, row_id, "_label", round(prob_value, 6) AS score FROM stacked
UNION ALL SELECT 'keyword', row_id, "_label", round(prob_keyword, 6) FROM stacked
UNION ALL SELECT 'shape', row_id, "_label", round(prob_shape, 6) FROM stacked"""


def with_scored(body: str, *extra: tuple[str, str]) -> str:
    return with_features(body, ("stacked", STACKED_SQL), ("scored", SCORED_SQL), *extra)

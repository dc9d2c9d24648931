"""Joins that bring outside predictions, events and reasons together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.session import LABEL, ROW_ID


def prediction_to_prob(label: Column, confidence: Column, numeric: Column | None = None, signed: bool = False) -> Column:
    """A numeric confidence as it is, else 1 or 0 from the label word.

    ``numeric`` says whether the source value was a number; text never counts, so without ``numeric`` only the
    label does. With ``signed`` a benign verdict's confidence is turned around.
    """
    malicious = F.lower(F.coalesce(label, F.lit("unknown"))) == "malicious"
    value = F.lit(None).cast("double") if numeric is None else F.when(numeric, confidence.try_cast("double"))
    if signed:
        value = F.when(malicious, value).otherwise(1.0 - value)
    return F.coalesce(value, F.when(malicious, 1.0).otherwise(0.0))


def latest_per_row(predictions: DataFrame, order_by: str, row_id: str = ROW_ID) -> DataFrame:
    """The last prediction per row id; rows without an id are dropped."""
    fields = [c for c in predictions.columns if c != row_id]
    last = F.max_by(F.struct(*fields), F.col(order_by)).alias("_last")
    return predictions.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(last).select(row_id, "_last.*")


def missing_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    return df.join(predictions.select(ROW_ID), ROW_ID, "left_anti")


def attach_predictions(df: DataFrame, predictions: DataFrame, order_by: str, check: bool = True) -> DataFrame:
    """Events with their latest outside prediction; an event without one is an error."""
    latest = latest_per_row(predictions, order_by)
    if check:
        if latest.isEmpty():
            raise ValueError("no usable predictions")
        gap = missing_predictions(df, latest).select(ROW_ID).limit(1).collect()
        if gap:
            raise ValueError(f"no prediction for row {gap[0][0]}")
    return df.join(latest, ROW_ID)


def first_present(*choices: Column) -> Column:
    """First choice that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def build_review_inputs(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions with event text, the verdict and the ground truth; fields of the prediction win."""
    e = events.select(
        ROW_ID,
        "CommandLine",
        "SourceImage",
        F.col("prompt").alias("_prompt"),
        F.col("verdict_json").alias("_verdict"),
        F.col("verdict_label").alias("_verdict_label"),
        F.col(LABEL).alias("ground_truth"),
    )
    p = predictions.drop("CommandLine", "SourceImage", "ground_truth")
    present = set(p.columns)

    def own(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    return p.join(e, ROW_ID, "left").select(
        ROW_ID,
        "CommandLine",
        "SourceImage",
        first_present(own("prompt"), F.col("_prompt")).alias("prompt"),
        first_present(own("verdict_json"), F.col("_verdict")).alias("verdict_json"),
        first_present(own("verdict_label"), F.col("_verdict_label")).alias("verdict_label"),
        "ground_truth",
        F.struct(
            own("label").alias("label"),
            F.col("score").cast("double").alias("score") if "score" in present else F.lit(None).cast("double").alias("score"),
            first_present(own("llm_reason"), own("explanation")).alias("llm_reason"),
            F.lit("LLM reason is explanatory only; classifier is a non-LLM model.").alias("note"),
        ).alias("prediction"),
    )


def attach_reasons(explanations: DataFrame, reasons: DataFrame) -> DataFrame:
    """Explanations with the reason generated for the same row id."""
    return explanations.join(reasons.select(ROW_ID, "llm_reason"), ROW_ID)

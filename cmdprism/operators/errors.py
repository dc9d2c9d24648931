"""Error analysis of scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cmdprism.functions.features import FLAG_FEATURES
from cmdprism.session import LABEL, ROW_ID


def with_error_type(df: DataFrame, threshold: float = 0.5, label: str = LABEL, score: str = "score") -> DataFrame:
    """Add ``prediction`` and ``error_type`` (FP, FN or NULL)."""
    hit = (F.col(score) >= threshold).cast("int")
    kind = F.when((hit == 1) & (F.col(label) == 0), "FP").when((hit == 0) & (F.col(label) == 1), "FN")
    return df.withColumns({"prediction": hit, "error_type": kind})


def attach_features(predictions: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions with their features, by row id."""
    return predictions.join(features.select(ROW_ID, *columns), ROW_ID, "left")


def attach_text(errors: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """Misclassified rows with the event's own text columns."""
    return errors.where(F.col("error_type").isNotNull()).join(events.select(ROW_ID, *columns), ROW_ID, "left")


def error_clusters(errors: DataFrame, by: str = "source_image_base", n: int = 3) -> DataFrame:
    """The ``n`` most frequent values per error type."""
    counted = errors.where(F.col("error_type").isNotNull()).groupBy("error_type", by).agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy("error_type").orderBy(F.col("n_rows").desc(), F.col(by))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def error_flag_totals(errors: DataFrame, flags: list[str] = FLAG_FEATURES, n: int = 5) -> DataFrame:
    """The ``n`` flags that fire most often per error type (ties in feature order)."""
    sums = errors.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(*[F.sum(f).alias(f) for f in flags])
    items = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("flag"), F.col(f).alias("total"))
            for i, f in enumerate(flags)
        ]
    )
    order = Window.partitionBy("error_type").orderBy(F.col("total").desc(), "ordinal")
    ranked = sums.select("error_type", F.inline(items)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).drop("ordinal")


def error_examples(errors: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows per error type by row id."""
    order = Window.partitionBy("error_type").orderBy(ROW_ID)
    ranked = errors.where(F.col("error_type").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)

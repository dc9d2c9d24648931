"""Scores as columns: linear scorers, stacked providers, score tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.session import LABEL, ROW_ID

Provider = tuple[str, Callable[[DataFrame], DataFrame]]


def linear_margin(coefficients: dict[str, float], intercept: float) -> Column:
    terms = [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight for name, weight in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(intercept))


def logistic(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def linear_provider(name: str, coefficients: dict[str, float], intercept: float) -> Provider:
    """A scorer with fixed weights that adds ``prob_<name>``."""
    return name, lambda df: df.withColumn(f"prob_{name}", logistic(linear_margin(coefficients, intercept)))


def stack_probabilities(df: DataFrame, providers: Sequence[Provider]) -> DataFrame:
    """Add one ``prob_<name>`` column per provider, all within the same pass where they are expressions."""
    return reduce(lambda out, provider: provider[1](out), providers, df)


def label_at(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Add ``prediction`` (score at or above the threshold) and its word."""
    hit = F.col(score) >= threshold
    return df.withColumns(
        {"prediction": hit.cast("int"), "predicted_word": F.when(hit, "malicious").otherwise("benign")}
    )


def score_table(df: DataFrame, names: Sequence[str], label: str = LABEL, row_id: str = ROW_ID) -> DataFrame:
    """``prob_*`` columns as one row per model and event: (model, row_id, label, prob)."""
    items = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"prob_{n}").alias("prob")) for n in names])
    return df.select(row_id, label, F.inline(items))

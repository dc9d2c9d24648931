"""Validation, labels, identity columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cmdprism.functions import text as tx
from cmdprism.functions.labels import label_from_variant
from cmdprism.functions.numbers import fixed
from cmdprism.plans.prefix import rank_in_order
from cmdprism.session import COMMAND, GROUP_KEY, IMAGE, LABEL, ROW_ID


def with_row_id(df: DataFrame, order_by: str, row_id: str = ROW_ID) -> DataFrame:
    """Dense 0-based id in the order of a unique column."""
    number = isinstance(df.schema[order_by].dataType, NumericType)
    ranked = rank_in_order(df.withColumn("_all", F.lit(0)), ["_all"], [F.col(order_by)], key=F.col(order_by) if number else None)
    return ranked.withColumnRenamed("_rank", row_id).drop("_all", "_n")


def with_row_hash(df: DataFrame, command: str = COMMAND, image: str = IMAGE, prompt: str = "prompt") -> DataFrame:
    return df.withColumn("row_hash", tx.row_hash(F.col(command), F.col(image), F.col(prompt)))


def add_group_key(
    df: DataFrame, command: str = COMMAND, image: str = IMAGE, windows_paths: bool = False
) -> DataFrame:
    return df.withColumn(GROUP_KEY, tx.group_key(F.col(image), F.col(command), windows_paths))


def resolve_label(events: DataFrame) -> DataFrame:
    """Add ``_resolved``: the flat label where it holds a value, else the one inside the verdict."""
    flat = F.when(~F.expr("is_variant_null(flat_label)"), F.col("flat_label"))
    nested = F.when(~F.expr("is_variant_null(verdict.predicted_label)"), F.col("verdict.predicted_label"))
    return events.withColumn("_resolved", F.coalesce(flat, nested))


def check_events(events: DataFrame) -> DataFrame:
    """Scanned events with the normalised label and a ``reject_reason`` (NULL for usable rows)."""
    code = label_from_variant("_resolved")
    reason = (
        F.when(F.col("_resolved").isNull(), "missing_label")
        .when(F.col(LABEL).isNull(), "invalid_label")
        .when(F.size("bad_fields") > 0, "non_text_field")
    )
    verdict = F.struct(
        F.expr("try_variant_get(verdict.predicted_label, '$', 'string')").alias("predicted_label"),
        *[F.col(f"verdict.{n}").alias(n) for n in ("reason", "confidence", "attack_technique", "technique")],
    )
    return (
        resolve_label(events)
        .withColumn(LABEL, code)
        .withColumn("reject_reason", reason)
        .withColumn("predicted_label", F.expr("try_variant_get(_resolved, '$', 'string')"))
        .withColumn("verdict", F.when(F.col("verdict").isNotNull(), verdict))
        .drop("_resolved", "flat_label", "bad_fields")
    )


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events with ``_label``, and the rejected ones with their reason."""
    checked = check_events(events)
    valid = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = checked.where(F.col("reject_reason").isNotNull())
    return valid, rejected


def reject_counts(checked: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("reject_reason"), F.lit("valid"))
    return checked.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n_rows"))


def require_labeled(df: DataFrame, label: str = LABEL) -> DataFrame:
    labeled = df.where(F.col(label).isNotNull())
    if labeled.isEmpty():
        raise ValueError("no labeled rows available")
    return labeled


def sample_rows(df: DataFrame, n: int, order_by: str = ROW_ID) -> DataFrame:
    """The first ``n`` rows by id (a sampling operator, so the limit is its purpose)."""
    return df.orderBy(order_by).limit(n)


def display_columns(df: DataFrame, score: str = "score") -> DataFrame:
    """Short texts and rounded score for report tables."""
    return df.withColumns(
        {
            "command_short": F.substring(tx.text_or_empty(F.col(COMMAND)), 1, 120),
            "image_short": F.substring(tx.text_or_empty(F.col(IMAGE)), 1, 40),
            "score_short": fixed(F.col(score), 3),
        }
    )

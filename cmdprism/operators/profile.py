"""Data overview: counts, top values, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from cmdprism.functions.numbers import ratio
from cmdprism.plans.quantiles import exact_quantiles
from cmdprism.session import GROUP_KEY, IMAGE, LABEL
from cmdprism.sources.tables import materialize


def top_values(df: DataFrame, value: Column, n: int = 10, name: str = "value") -> DataFrame:
    """The ``n`` most frequent non-null values, smallest value first on ties."""
    counted = df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("n_rows")
    )
    return counted.orderBy(F.col("n_rows").desc(), F.col(name)).limit(n)


def top_groups(df: DataFrame, n: int = 10, group: str = GROUP_KEY) -> DataFrame:
    return top_values(df, F.col(group), n, group)


def top_images(df: DataFrame, n: int = 10, image: str = IMAGE) -> DataFrame:
    return top_values(df, F.lower(image), n, "image")


def data_overview(df: DataFrame, label: str = LABEL) -> DataFrame:
    total = F.count("*")
    positive = F.count_if(F.col(label) == 1)
    return df.agg(
        total.alias("total_rows"),
        positive.alias("malicious_rows"),
        F.count_if(F.col(label) == 0).alias("benign_rows"),
        ratio(positive, total).alias("malicious_ratio"),
    )


def label_crosstab(df: DataFrame, left: str, right: str, right_values: list[str]) -> DataFrame:
    """Counts of lower-cased left values by lower-cased right values, one column each."""
    counted = df.select(F.lower(F.col(left).cast("string")).alias(left), F.lower(F.col(right).cast("string")).alias(right))
    return counted.groupBy(left).pivot(right, right_values).count().fillna(0)


def top_by_group(df: DataFrame, group: str, value: Column, n: int, name: str = "value") -> DataFrame:
    """The ``n`` most frequent values per group.

    The rank filter lets Spark keep only ``n`` rows per group in each task before the shuffle.
    """
    counted = df.select(group, value.alias(name)).where(F.col(name).isNotNull()).groupBy(group, name).agg(
        F.count("*").alias("n_rows")
    )
    order = Window.partitionBy(group).orderBy(F.col("n_rows").desc(), F.col(name))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_images_by_label(df: DataFrame, label: str, label_values: list, n: int = 5, image: str = IMAGE) -> DataFrame:
    """Top images of every label, images down and labels across, zero where absent."""
    top = top_by_group(df, label, F.lower(image), n, "image")
    return top.groupBy("image").pivot(label, label_values).agg(F.sum("n_rows")).fillna(0)


def length_distribution(df: DataFrame, by: str, length: Column) -> DataFrame:
    """Box-plot numbers per group. Whole lengths are few different numbers, so each task keeps a counter for each; quantiles of
    fractions, which may all differ, are found by rank."""
    if isinstance(df.select(length).schema[0].dataType, FractionalType):
        return _fraction_distribution(df, by, length)
    quartiles = F.percentile(F.col("_len"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.select(by, length.alias("_len")).groupBy(by).agg(
        F.min("_len").alias("min_len"), quartiles.alias("_q"), F.max("_len").alias("max_len"), F.count("*").alias("n_rows")
    )
    return stats.select(
        by, "min_len", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
        "max_len", "n_rows",
    )


def _fraction_distribution(df: DataFrame, by: str, length: Column) -> DataFrame:
    rows = materialize(df.select(by, length.alias("_len")), "lengths")
    stats = rows.groupBy(by).agg(F.min("_len").alias("min_len"), F.max("_len").alias("max_len"), F.count("*").alias("n_rows"))
    found = exact_quantiles(rows, ["_len"], [0.25, 0.5, 0.75], [by]).groupBy(by).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    found = found.toDF("_by", "q1", "median", "q3")
    joined = stats.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, "min_len", "q1", "median", "q3", "max_len", "n_rows")


def majority_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Most frequent label, the smallest on ties (one row)."""
    counted = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.col("n_rows").desc(), F.col(label)).limit(1).select(F.col(label).alias("majority_label"))

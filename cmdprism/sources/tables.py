"""Parquet tables: processed events, splits, rules, thresholds, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.session import LABEL, scratch_path

RULE_SCHEMA = "ordinal INT, name STRING, kind STRING, feature STRING, threshold DOUBLE, categories ARRAY<STRING>"
DEFAULT_THRESHOLD = 0.5


def write_processed(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_processed(spark: SparkSession, path: str, label: str = LABEL) -> DataFrame:
    df = spark.read.parquet(path)
    if label not in df.columns:
        raise ValueError(f"column {label} missing in {path}")
    return df


def write_splits(splits: DataFrame, path: str, ratios: tuple[float, float, float], seed: int) -> None:
    """The split table, one folder per split, and a one-row manifest."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/assignments")
    manifest = splits.sparkSession.createDataFrame([(list(ratios), seed)], "ratios ARRAY<DOUBLE>, seed INT")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/assignments")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def append_metrics(df: DataFrame, path: str, run: str) -> None:
    """Add the rows of a run to a metric table (per-model metrics or threshold points)."""
    df.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The rows of one run; a repeated job takes a new run."""
    return spark.read.parquet(path).where(F.col("run") == run).drop("run")


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).parquet(path)


def write_threshold(calibrated: DataFrame, path: str) -> None:
    """A calibrated threshold with its precision and recall, as one row."""
    calibrated.select("threshold", "precision", "recall", "recall_target", "achieved_target").write.mode("overwrite").parquet(path)


def read_threshold(spark: SparkSession, path: str | None) -> float:
    """The calibrated threshold, or the default where none was saved."""
    if path is None:
        return DEFAULT_THRESHOLD
    row = spark.read.parquet(path).select(F.max("threshold").alias("t")).first()
    return DEFAULT_THRESHOLD if row is None or row["t"] is None else float(row["t"])


#: Rows of a task, on average. A scan is cut by bytes, and a split of short rows that pack well holds millions of them.
SPREAD_ROWS = 1 << 16


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores where a small file gives fewer scan tasks than there are cores, and more tasks where short rows make them long.

    Meant for CPU-heavy expressions; an input with enough splits is returned as it is. The rows are counted from the files' footers.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read to the shared folder, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

"""Cost, latency and dashboard tables per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which kind of machine serves a model; any other model runs on cpu_small.
RESOURCES = {
    "gbdt": "cpu_small",
    "xgb": "cpu_small",
    "rf": "cpu_small",
    "text": "cpu_small",
    "st": "gpu_small",
    "ensemble_gbdt_tfidf": "cpu_small",
    "ensemble_gbdt_st": "gpu_small",
    "ensemble_xgb_tfidf": "cpu_small",
    "ensemble_xgb_st": "gpu_small",
    "ensemble_rf_tfidf": "cpu_small",
    "ensemble_rf_st": "gpu_small",
    "llm": "gpu_small",
    "claude": "api",
}
DEFAULT_RESOURCE = "cpu_small"
# Fixed values: (resource, price per hour, price per request, description).
PRICES = [
    ("cpu_small", 0.096, None, "AWS m5.large on-demand (2 vCPU)"),
    ("gpu_small", 1.006, None, "AWS g5.2xlarge on-demand (1xL4)"),
    ("api", None, 0.0018, "Claude Sonnet 4.5 (assignment brief)"),
]
UTILIZATION = 0.7
BASELINE = "claude"


def resource_table(spark: SparkSession, resources: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((resources or RESOURCES).items()), "cost_model STRING, resource STRING")


def price_table(spark: SparkSession, prices: list[tuple] | None = None) -> DataFrame:
    schema = "resource STRING, hourly_usd DOUBLE, per_request_usd DOUBLE, description STRING"
    return spark.createDataFrame(prices or PRICES, schema)


def with_prices(models: DataFrame, resources: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Each model with its resource and the resource's price (both lookups are fixed small tables)."""
    spark = models.sparkSession
    resources = resources if resources is not None else resource_table(spark)
    prices = prices if prices is not None else price_table(spark)
    keyed = models.join(resources, F.lower("model") == F.col("cost_model"), "left").drop("cost_model")
    keyed = keyed.withColumn("resource", F.coalesce("resource", F.lit(DEFAULT_RESOURCE)))
    return keyed.join(prices, "resource", "left")


def cost_from_latency(latency: Column, hourly: Column, utilization: float) -> Column:
    """Price of one prediction on a machine that is busy ``utilization`` of the time; NULL if any input is not positive."""
    per_hour = (F.lit(3600.0) / latency) * utilization
    return F.when((latency > 0) & (hourly > 0) & (F.lit(utilization) > 0), hourly / per_hour)


def cost_per_prediction(
    models: DataFrame, existing: DataFrame | None = None, utilization: float = UTILIZATION,
    resources: DataFrame | None = None, prices: DataFrame | None = None,
) -> DataFrame:
    """Cost table (model, per_prediction_usd, latency_seconds, notes) from measured latencies.

    A model whose cost cannot be computed keeps its old one; notes are appended.
    """
    priced = with_prices(models.where(F.col("model").isNotNull()), resources, prices)
    if existing is None:
        old = "per_prediction_usd DOUBLE, notes STRING"
        priced = priced.select("*", *[F.lit(None).cast(t).alias(f"_old_{n}") for n, t in (x.split() for x in old.split(", "))])
    else:
        before = existing.select(
            F.col("model").alias("_m"), F.col("per_prediction_usd").alias("_old_per_prediction_usd"),
            F.col("notes").alias("_old_notes"),
        )
        priced = priced.join(before, F.lower("model") == F.col("_m"), "left").drop("_m")
    api = F.col("resource") == "api"
    latency = F.coalesce(F.col("latency_seconds"), F.lit(0.0))
    computed = cost_from_latency(latency, F.coalesce(F.col("hourly_usd"), F.lit(0.0)), utilization)
    note = F.when(api, F.col("description")).otherwise(F.concat("description", F.lit(f" @ util={utilization}")))
    return priced.select(
        F.lower("model").alias("model"),
        F.when(api, F.col("per_request_usd")).otherwise(computed).alias("_cost"),
        F.when(api, F.col("latency_seconds")).otherwise(latency).alias("latency_seconds"),
        F.concat_ws(" | ", F.nullif("_old_notes", F.lit("")), note).alias("notes"),
        "_old_per_prediction_usd",
    ).select("model", F.coalesce("_cost", "_old_per_prediction_usd").alias("per_prediction_usd"), "latency_seconds", "notes")


def attach_costs(models: DataFrame, costs: DataFrame) -> DataFrame:
    """Models with their cost, matched in lower case; 0 where none is known."""
    priced = costs.select(F.lower("model").alias("_m"), "per_prediction_usd")
    joined = models.join(priced, F.lower("model") == F.col("_m"), "left").drop("_m")
    return joined.withColumn("per_prediction_usd", F.coalesce("per_prediction_usd", F.lit(0.0)))


def _quotient(a: Column, b: Column) -> Column:
    return F.when((a != 0) & (b != 0), a / b)


def cost_benchmark(
    models: DataFrame, costs: DataFrame, baseline_metrics: DataFrame, baseline: str = BASELINE
) -> DataFrame:
    """The baseline and all models with cost per million, speed-up and savings against the baseline.

    ``models`` has precision_1, recall_1, f1_1, roc_auc, average_precision, per_row_seconds and
    an ``ordinal``; ``baseline_metrics`` the same metrics in one row.
    """
    metric = ["precision_1", "recall_1", "f1_1", "roc_auc", "average_precision"]
    found = costs.where(F.lower("model") == baseline).agg(F.max("per_prediction_usd"), F.max("latency_seconds")).first()
    base_cost, base_latency = F.lit(found[0] or 0.0), F.lit(found[1] or 0.0)
    million = F.col("per_prediction_usd") * 1_000_000
    latency = F.coalesce(F.col("per_row_seconds"), F.lit(0.0))
    table = attach_costs(models, costs).select(
        "ordinal", "model", *metric, latency.alias("latency_seconds"), million.alias("per_million_usd"),
        _quotient(base_latency, latency).alias("speedup"),
        _quotient(base_cost, F.col("per_prediction_usd")).alias("savings"),
    )
    first = baseline_metrics.select(
        F.lit(-1).alias("ordinal"), F.lit(baseline).alias("model"), *metric, base_latency.alias("latency_seconds"),
        (base_cost * 1_000_000).alias("per_million_usd"), F.lit(1.0).alias("speedup"), F.lit(1.0).alias("savings"),
    )
    return first.unionByName(table)


def leaders(benchmark: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Model of best recall, the fastest and the cheapest; the first listed wins ties."""

    def best(value: Column) -> Column:
        return F.max_by("model", F.struct(F.coalesce(value, F.lit(0.0)), -F.col("ordinal")))

    return benchmark.where(F.col("model") != baseline).agg(
        best(F.col("recall_1")).alias("best_recall"), best(F.col("speedup")).alias("fastest"),
        best(F.col("savings")).alias("cheapest"),
    )


def dashboard_table(metrics: DataFrame) -> DataFrame:
    """The headline numbers per model, latency in milliseconds."""
    return metrics.select(
        "model", "accuracy", F.col("precision_1").alias("precision"), F.col("recall_1").alias("recall"),
        F.col("f1_1").alias("f1"), "roc_auc", "average_precision", (F.col("per_row_seconds") * 1000).alias("latency_ms"),
    )


def dashboard_details(metrics: DataFrame, sampled: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Averages, the sampled threshold rows and the cost row of every model.

    The sampled rows number nine per model and become one array.
    """
    averages = [f"{a}_{x}" for a in ("macro", "weighted") for x in ("precision", "recall", "f1")]
    fields = ["threshold", "precision", "recall", "tp", "fp", "tn", "fn"]
    rows = sampled.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("target", *fields))).alias("threshold_rows"))
    money = benchmark.select("model", "per_million_usd", "speedup", "savings")
    return metrics.select("model", "n", *averages).join(rows, "model", "left").join(money, "model", "left")


"""Signals, contributions and narratives for scored events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from cmdprism.functions.numbers import fixed
from cmdprism.functions.signals import build_signals, feature_phrase
from cmdprism.operators.attribution import Attribution
from cmdprism.operators.models import Detector
from cmdprism.operators.trees import TreeModel
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import LABEL, ROW_ID
from cmdprism.sources.tables import SPREAD_ROWS, materialize

# Fixed value: smaller impacts are not reported.
MIN_IMPACT = 1e-4
#: Different rows of model inputs that are worth a task of their own.
TASK_INPUTS = 64
CONTRIBUTION = "STRUCT<feature: STRING, phrase: STRING, value: STRING, impact: DOUBLE>"


def with_signals(features: DataFrame, top_k: int | None = None) -> DataFrame:
    signals = build_signals(features.columns)
    return features.withColumn("signals", signals if top_k is None else F.slice(signals, 1, top_k))


def _top(items: Column, top_k: int) -> Column:
    """The ``top_k`` items of largest absolute impact; equal ones keep their order."""
    large = F.filter(items, lambda c: F.abs(c["impact"]) >= MIN_IMPACT)
    ordered = F.array_sort(
        F.transform(
            large,
            lambda c, i: F.struct(
                (-F.abs(c["impact"])).alias("_o"), i.alias("_i"), c["feature"].alias("feature"),
                c["value"].alias("value"), c["impact"].alias("impact"),
            ),
        )
    )
    return F.transform(
        F.slice(ordered, 1, top_k),
        lambda c: F.struct(
            c["feature"].alias("feature"), feature_phrase(c["feature"]).alias("phrase"), c["value"].alias("value"),
            c["impact"].alias("impact"),
        ),
    )


def linear_contributions(
    features: DataFrame, coefficients: dict[str, float], means: dict[str, float], top_k: int = 3
) -> DataFrame:
    """Exact impacts of a linear margin: coefficient times distance from the mean."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(name).cast("string").alias("value"),
                ((F.col(name).cast("double") - means.get(name, 0.0)) * weight).alias("impact"),
            )
            for name, weight in coefficients.items()
        ]
    )
    return features.withColumn("contributions", _top(items, top_k))


def feature_means(features: DataFrame, names: list[str]) -> dict[str, float]:
    row = features.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).first()
    return {n: float(row[n] or 0.0) for n in names}


def shown_features(features: list[tuple[str, str | None]]) -> list[tuple[str, Column]]:
    """Name and shown value of the features that the trees split on; a one-hot column is named after its value."""
    out = []
    for name, value in features:
        if value is not None:
            hit = F.coalesce(F.col(name), F.lit("unknown")) == value
            out.append((f"{name}_{value}", F.when(hit, "1.0").otherwise("0.0")))
        elif name in CATEGORICAL_FEATURES:
            out.append((name, F.col(name)))
        else:
            out.append((name, F.col(name).cast("double").cast("string")))
    return out


def tree_contributions(detector: Detector, df: DataFrame, top_k: int = 3, method: str = "shapley") -> tuple[DataFrame, float]:
    """Score events with a tree model and give the impacts of the features that the trees split on, with the base value.

    ``method``: ``shapley`` (path-dependent Shapley values) or ``path`` (credits along the decision path). All impacts and the base
    add up to the margin of boosted trees, and to the probability of a forest. Rows of equal inputs are computed once, over the whole
    table: the different ones are written, attributed in tasks of their own and joined back, so the cost of the trees goes by their number.
    """
    model = detector.trees
    attribution = Attribution(model, detector.config["feature_type"] == "ohe")
    prepared = detector.prepare(df)
    inputs = [*model.numbers, *model.categories]
    made = [c for c in ("score", "contributions") if c in prepared.columns]
    keyed = prepared.drop(*made).withColumns({"_input": input_digest(inputs), "_spread": F.monotonically_increasing_id()})
    different = materialize(keyed.groupBy("_input").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in inputs]), "tree-inputs")
    n = different.count()
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // TASK_INPUTS), -(-n // SPREAD_ROWS))
    staged = different.repartition(tasks, "_input").withColumn("score", model.probability())
    found = materialize(attributed(attribution, model, staged, top_k, method).select("_input", "_n", "score", "contributions"), "tree-impacts")
    out = attach_group_values(keyed, found, "_input", "_n", ["score", "contributions"], spread_by="_spread")
    return out.select(*dict.fromkeys([*prepared.columns, "score", "contributions"])), attribution.base


def input_digest(inputs: list[str]) -> Column:
    """A digest of a row's model inputs: equal where all of them are, nulls included."""
    return F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)


def attributed(attribution: Attribution, model: TreeModel, scored: DataFrame, top_k: int, method: str) -> DataFrame:
    """Scored rows of model inputs with their ``contributions``."""
    used = shown_features(attribution.features)
    keep = min(top_k, len(used))
    if not keep:
        return scored.withColumn("contributions", F.array().cast(f"ARRAY<{CONTRIBUTION}>"))

    @F.pandas_udf("index array<int>, impact array<double>")
    def attribute(numbers: pd.Series, *categories: pd.Series) -> pd.DataFrame:
        impacts = attribution.impacts(method, *attribution.walker.arrays(numbers, categories))
        order = np.argsort(-np.abs(impacts), axis=1, kind="stable")[:, :keep]
        top = np.take_along_axis(impacts, order, axis=1)
        return pd.DataFrame({"index": list(order.astype(np.int32)), "impact": list(top)})

    labels = F.array(*[F.lit(name) for name, _ in used])
    staged = scored.withColumns({"_impacts": attribute(*model.inputs()), "_values": F.array(*[shown for _, shown in used])})
    items = F.zip_with(
        "_impacts.index",
        "_impacts.impact",
        lambda i, impact: F.struct(
            F.element_at(labels, i + 1).alias("feature"), F.element_at(F.col("_values"), i + 1).alias("value"), impact.alias("impact")
        ),
    )
    return staged.withColumn("contributions", _top(items, top_k)).drop("_impacts", "_values")


def explain(df: DataFrame, score: str = "score", threshold: float = 0.5, top_k: int = 3) -> DataFrame:
    """Label, threshold, top signals, contributions and a one-sentence narrative per event.

    ``df`` has features and a score, and optionally ``contributions``.
    """
    if "contributions" not in df.columns:
        df = df.withColumn("contributions", F.array().cast(f"ARRAY<{CONTRIBUTION}>"))
    hit = F.col(score) >= threshold
    pushes = F.array_join(
        F.transform(
            "contributions",
            lambda c: F.concat(c["phrase"], F.lit(" ("), fixed(c["impact"], 2, plus=True), F.lit(")")),
        ),
        ", ",
    )
    has_pushes = F.size("contributions") > 0
    shown = fixed(F.col(score), 2)
    # The wordings of the narrative.
    narrative = (
        F.when(hit & has_pushes, F.concat(F.lit("Model score "), shown, F.lit(" driven by "), pushes, F.lit(".")))
        .when(
            hit & (F.size("signals") > 0), F.concat(F.lit("Flagged due to: "), F.array_join("signals", ", "), F.lit("."))
        )
        .when(hit, "Flagged by the GBDT model despite no discrete heuristics firing.")
        .when(
            has_pushes,
            F.concat(
                F.lit("Predicted benign ("), shown, F.lit("); biggest pushes were "), pushes, F.lit(" toward benign.")
            ),
        )
        .otherwise("Predicted benign; no high-risk features triggered.")
    )
    return with_signals(df, top_k).withColumns(
        {
            "label": F.when(hit, "malicious").otherwise("benign"),
            "score": F.col(score),
            "threshold": F.lit(float(threshold)),
            "explanation": narrative,
        }
    )


def export_explanations(explained: DataFrame, events: DataFrame) -> DataFrame:
    """Explanation records joined with the event fields a reviewer needs."""
    fields = ["CommandLine", "SourceImage", LABEL, "prompt", "verdict_json", "verdict_label"]
    record = explained.select(ROW_ID, "label", "score", "threshold", "signals", "explanation", "contributions")
    return record.join(events.select(ROW_ID, *fields), ROW_ID)

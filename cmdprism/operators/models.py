"""Detectors: training, tuning, saving, batch scoring, comparison. Regressions are MLlib's, trees are those of ``trees``."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cmdprism.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, build_features
from cmdprism.functions.text import clean_command_text
from cmdprism.operators import metrics as m
from cmdprism.operators import trees
from cmdprism.operators.growth import Layout, TreeParams
from cmdprism.operators.scoring import Provider, stack_probabilities
from cmdprism.operators.splits import stratified_kfold
from cmdprism.operators.textmodel import fit_vectorizer, vocabulary_size, with_terms
from cmdprism.plans.prefix import rank_in_order
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import COMMAND, LABEL, ROW_ID
from cmdprism.sources.tables import materialize

if TYPE_CHECKING:
    from cmdprism.operators.sparse_lr import TextWeights

# Default training parameters.
SEED = 13
GBDT_PARAMS = {
    "n_estimators": 300, "learning_rate": 0.05, "num_leaves": 31, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_samples": 20,
    "min_child_weight": 1e-3, "reg_lambda": 0.0,
}
BOOSTED_PARAMS = {
    "n_estimators": 400, "learning_rate": 0.05, "max_depth": 5, "subsample": 0.8, "subsample_freq": 1, "colsample_bytree": 0.8,
    "reg_lambda": 1.0, "min_child_weight": 1.0, "min_child_samples": 1, "num_leaves": None, "native_categories": False,
}
FOREST_PARAMS = {"n_estimators": 400, "max_depth": None, "num_leaves": None, "native_categories": False, "forest": True}
TEXT_C = 2.0
ENSEMBLE_C = 4.0
MAX_ITER = 500
#: The table form ends when a round takes less than this share of the first loss off it; MLlib's ends when ten take less than 1e-6.
SETTLED = 1e-7
#: Megabytes of rows that the solver takes at a time; for each block it makes a vector as long as all weights.
BLOCK_MB = 64.0
TUNING_GRIDS = {
    "gbdt": {"learning_rate": [0.03, 0.05, 0.1], "num_leaves": [31, 63], "reg_lambda": [0.0, 0.1]},
    "xgb": {"max_depth": [4, 5, 6], "learning_rate": [0.03, 0.05, 0.1]},
    "rf": {"max_depth": [None, 20], "n_estimators": [300, 500]},
}
TREE_MODELS = ("gbdt", "xgb", "rf")


@dataclass
class Detector:
    """A fitted pipeline with what is needed to apply it to raw events."""

    name: str
    kind: str
    pipeline: PipelineModel | None
    config: dict = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)
    encoder: Callable | None = None
    trees: trees.TreeModel | None = None
    #: Vocabulary and weights of a text model that are too many for the driver, as ``sparse_lr.TextWeights``.
    weights: TextWeights | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        if self.kind == "tree":
            return df if set(NUMERIC_FEATURES) <= set(df.columns) else build_features(df)
        if self.kind == "tfidf":
            return with_terms(df, accents=self.config.get("strip_accents", True))
        if self.kind == "sentence":
            if "embedding" not in df.columns:
                df = embed_column(df, self.encoder, self.config.get("batch_size", 32))
            return df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        raise ValueError(f"unknown provider type: {self.kind}")

    def score(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """Add the probability of class 1; helper columns of the pipeline are dropped."""
        out = out or f"prob_{self.name}"
        if self.kind == "tree":
            return self.prepare(df).withColumn(out, self.trees.probability()).select(*df.columns, out)
        if self.weights is not None:
            return self.weights.score(df, out)
        scored = self.pipeline.transform(self.prepare(df))
        return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)

    def provider(self) -> Provider:
        return self.name, lambda df: self.score(df)


# ---- preparation -------------------------------------------------------------------------


def with_class_weight(df: DataFrame, mode: str = "balanced", label: str = LABEL, out: str = "weight") -> DataFrame:
    """``balanced``: n / (2 n_c) per class; ``positive``: negatives per positive for class 1."""
    zero, one = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if mode == "balanced":
        weights = {c: (zero + one) / (2.0 * n) if n else 0.0 for c, n in ((0, zero), (1, one))}
    elif mode == "positive":
        weights = {0: 1.0, 1: zero / max(one, 1)}
    else:
        raise ValueError(f"unknown class weight mode: {mode}")
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])))


def category_tables(df: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> dict[str, DataFrame]:
    """Per column a written table of all its values: (value, index, n), the most frequent value first."""
    tables = {}
    for name in columns:
        counts = df.groupBy(F.coalesce(F.col(name), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
        ranked = rank_in_order(counts.withColumn("_all", F.lit(0)), ["_all"], [F.col("n").desc(), F.col("value")])
        tables[name] = materialize(ranked.select("value", F.col("_rank").cast("double").alias("index"), "n"), "categories")
    return tables


def with_category_indexes(df: DataFrame, tables: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """Add ``<column>_index`` by joins that large categories don't skew; values not in the table share the last index."""
    out = df.withColumn("_spread", F.monotonically_increasing_id())
    for name, table in tables.items():
        keyed = out.withColumn("_category", F.coalesce(F.col(name), F.lit("unknown")))
        listed = table.select(F.col("value").alias("_category"), "n", F.col("index").alias("_index"))
        found = attach_group_values(keyed, listed, "_category", "n", ["_index"], spread_by="_spread")
        index = F.coalesce("_index", F.lit(float(sizes[name])))
        out = found.withColumn(f"{name}_index", index).drop("_category", "_index")
    return nominal_indexes(out.drop("_spread"), sizes)


def matrix_stages(one_hot_input: bool, columns: Sequence[str] = CATEGORICAL_FEATURES) -> list:
    """Assembler of the feature matrix from numbers and category indexes, as one-hot blocks or as categories."""
    indexes = [f"{c}_index" for c in columns]
    if not one_hot_input:
        return [VectorAssembler(inputCols=[*NUMERIC_FEATURES, *indexes], outputCol="features")]
    hot = [f"{c}_hot" for c in columns]
    encoder = OneHotEncoder(inputCols=indexes, outputCols=hot, dropLast=False, handleInvalid="error")
    return [encoder, VectorAssembler(inputCols=[*NUMERIC_FEATURES, *hot], outputCol="features")]


def table_sizes(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: table.count() for name, table in tables.items()}


def one_hot(df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], dict[str, int]]:
    """Feature table with the sparse one-hot matrix in ``features``, its category tables and their sizes.

    The matrix has the numbers first, then one block per categorical: a column for each value by its index, and one for all others.
    """
    filled = df.fillna(0.0, NUMERIC_FEATURES)
    tables = category_tables(filled)
    sizes = table_sizes(tables)
    indexed = with_category_indexes(filled, tables, sizes)
    return Pipeline(stages=matrix_stages(True)).fit(indexed).transform(indexed), tables, sizes


def column_names(tables: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """(pos, column_name) of every column of the one-hot matrix, as a table."""
    spark = next(iter(tables.values())).sparkSession
    parts = [spark.createDataFrame(list(enumerate(NUMERIC_FEATURES)), "pos BIGINT, column_name STRING")]
    offset = len(NUMERIC_FEATURES)
    for name, table in tables.items():
        named = table.select((F.col("index").cast("bigint") + offset).alias("pos"), F.concat(F.lit(f"{name}_"), "value").alias("column_name"))
        other = spark.createDataFrame([(offset + sizes[name], f"{name}_other")], "pos BIGINT, column_name STRING")
        parts += [named, other]
        offset += sizes[name] + 1
    return reduce(DataFrame.unionByName, parts)


def embed_column(df: DataFrame, make_encoder: Callable, batch_size: int = 32, text: str = COMMAND) -> DataFrame:
    """Add ``embedding``: a batched encoder over the cleaned text, in Arrow batches.

    ``make_encoder`` builds, once per worker, a function from an array of texts to a matrix.
    """
    if make_encoder is None:
        raise ValueError("an encoder is needed where no embedding column exists")

    def make_predict() -> Callable:
        encode = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(encode([str(t) for t in texts]), dtype=np.float32)

        return predict

    embed = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", embed(clean_command_text(F.col(text))))


# ---- training ----------------------------------------------------------------------------


def logistic_regression(c: float, total_weight: float, max_iter: int = MAX_ITER, label: str = LABEL) -> LogisticRegression:
    """L2-regularised regression with inverse strength ``c`` on the summed weighted loss."""
    return LogisticRegression(
        labelCol=label, featuresCol="features", weightCol="weight", regParam=1.0 / (c * max(total_weight, 1.0)),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, maxBlockSizeInMB=BLOCK_MB,
    )


def _labeled(df: DataFrame) -> tuple[DataFrame, int]:
    labeled = df.where(F.col(LABEL).isNotNull())
    n = labeled.count()
    if n == 0:
        raise ValueError("no labeled rows available")
    return with_class_weight(labeled), n


def equal_texts(weighted: DataFrame, text: str = COMMAND) -> DataFrame:
    """Rows of equal text and label as one with their summed ``weight`` and their number ``n``, written once: the loss is the same, and
    every round of a solver reads less, in as few tasks as the bytes need. Each task of a round returns a slope per term."""
    sums = weighted.groupBy(text, LABEL).agg((F.max("weight") * F.count("*")).alias("weight"), F.count("*").alias("n"))
    return materialize(sums, "equal-texts")


def train_text_lr(
    train: DataFrame, min_df: int = 1, max_features: int | None = None, c: float = TEXT_C, max_iter: int = MAX_ITER
) -> Detector:
    """A vocabulary that the driver can hold makes a pipeline of MLlib's, a larger one the table form with the same loss."""
    weighted, n = _labeled(train)
    terms = with_terms(equal_texts(weighted)).select("terms", LABEL, "weight", "n")
    config = {"C": c, "min_df": min_df, "max_features": max_features, "ngram_range": [1, 2], "strip_accents": True}
    size = vocabulary_size(terms, min_df, max_features, times="n")
    if size is None:
        from cmdprism.operators.sparse_lr import train_text_table

        weights = train_text_table(train, min_df, c, max_iter, max_features=max_features, tolerance=0.0, settled=SETTLED)
        return Detector("text", "tfidf", None, config, weights=weights)
    vectorizer = fit_vectorizer(terms, min_df, max_features, times="n", size=size)
    model = logistic_regression(c, n, max_iter).fit(vectorizer.transform(terms))
    return Detector("text", "tfidf", PipelineModel([*vectorizer.stages, model]), config, vectorizer.stages[0].vocabulary)


def train_embedding_lr(
    train: DataFrame, make_encoder: Callable | None = None, batch_size: int = 32, c: float = TEXT_C,
    max_iter: int = MAX_ITER,
) -> Detector:
    """Frozen vectors (a table column, or made by the encoder) and a regression on top."""
    weighted, n = _labeled(train)
    if "embedding" not in weighted.columns:
        weighted = embed_column(equal_texts(weighted), make_encoder, batch_size)
    vectors = weighted.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = logistic_regression(c, n, max_iter).fit(vectors.select("features", LABEL, "weight"))
    names = [f"embedding_{i}" for i in range(model.numFeatures)]
    return Detector("st", "sentence", PipelineModel([model]), {"C": c, "batch_size": batch_size}, names, make_encoder)


def nominal_indexes(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Mark the index columns as categories with one value more than their tables have."""
    for name, size in sizes.items():
        nominal = {"ml_attr": {"type": "nominal", "name": f"{name}_index", "num_vals": size + 1}}
        df = df.withMetadata(f"{name}_index", nominal)
    return df


def tree_params(defaults: dict, params: dict | None = None, class_weight: str | None = None) -> TreeParams:
    merged = {"random_state": SEED, "class_weight": class_weight, **defaults, **(params or {})}
    return TreeParams(**{k: v for k, v in merged.items() if v is not None or k in ("num_leaves", "max_depth", "class_weight")})


def binned_features(features: DataFrame, fold: str | None = None) -> tuple[DataFrame, Layout, dict[str, DataFrame]]:
    """Labelled features binned once into a written table, its layout, and the tables of the categories' codes.

    ``fold`` names a column with the row's fold. Rows are told apart in samples by ``row_id``, or by all features without one.
    """
    table = features.where(F.col(LABEL).isNotNull()).fillna(0.0, NUMERIC_FEATURES)
    tables = category_tables(table)
    sizes = table_sizes(tables)
    kept = [*([ROW_ID] if ROW_ID in table.columns else []), *([fold] if fold else []), LABEL, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    indexed = materialize(with_category_indexes(table.select(*kept), tables, sizes), "train")
    layout = trees.fit_layout(indexed, NUMERIC_FEATURES, CATEGORICAL_FEATURES, sizes)
    key = F.xxhash64(ROW_ID) if ROW_ID in kept else F.xxhash64(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)
    binned = trees.with_bins(indexed, layout, key, F.col(fold) if fold else F.lit(0))
    return binned, layout, tables


def _train_trees(name: str, features: DataFrame, p: TreeParams) -> Detector:
    binned, layout, tables = binned_features(features)
    base, made = trees.fit(binned, layout, p)
    config = {**p.__dict__, "feature_type": "categorical" if p.native_categories else "ohe"}
    model = trees.model_of(base, made, layout, p, tables)
    return Detector(name, "tree", None, config, [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES], trees=model)


def train_gbdt(features: DataFrame, params: dict | None = None, class_weight: str | None = None) -> Detector:
    """Leaf-wise boosted trees over the numbers and the categories as such.

    As in the library whose parameters these are, ``subsample`` takes effect with a ``subsample_freq`` only.
    """
    return _train_trees("gbdt", features, tree_params(GBDT_PARAMS, params, class_weight))


def train_boosted_ohe(features: DataFrame, params: dict | None = None, class_weight: str | None = "positive") -> Detector:
    """Boosted trees by level over the numbers and one-hot categories, positives weighted up."""
    return _train_trees("xgb", features, tree_params(BOOSTED_PARAMS, params, class_weight))


def train_random_forest(features: DataFrame, params: dict | None = None, class_weight: str | None = None) -> Detector:
    """A forest of full depth over the numbers and one-hot categories; each node draws the square root of the columns."""
    return _train_trees("rf", features, tree_params(FOREST_PARAMS, params, class_weight))


def train_stacked_ensemble(
    train: DataFrame, providers: Sequence[Provider], c: float = ENSEMBLE_C, max_iter: int = MAX_ITER
) -> tuple[PipelineModel, list[str]]:
    """Regression over the providers' probabilities; returns the model and its input columns."""
    weighted, n = _labeled(train)
    columns = [f"prob_{name}" for name, _ in providers]
    stacked = materialize(stack_probabilities(weighted, providers).select(*columns, LABEL, "weight"), "stacked")
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    model = Pipeline(stages=[assembler, logistic_regression(c, n, max_iter)]).fit(stacked)
    return model, columns


def score_ensemble(df: DataFrame, model: PipelineModel, providers: Sequence[Provider], name: str = "ensemble") -> DataFrame:
    stacked = stack_probabilities(df, providers)
    out = f"prob_{name}"
    scored = model.transform(stacked).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*stacked.columns, out)


def default_providers(available: dict[str, Detector]) -> list[Detector]:
    """First tree model and one text model (TF-IDF preferred); both are needed."""
    tree = next((available[n] for n in TREE_MODELS if n in available), None)
    text = available.get("text") or available.get("st")
    if tree is None or text is None:
        raise ValueError("an ensemble needs at least one tree model and one text model")
    return [tree, text]


# ---- saving ------------------------------------------------------------------------------


def save_detector(spark: SparkSession, detector: Detector, path: str) -> None:
    """Model, configuration and feature list under one prefix; a text model in table form has its terms beside their weights."""
    config = dict(detector.config)
    if detector.kind == "tree":
        model = detector.trees
        model.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        config["model"] = {"numbers": model.numbers, "categories": model.categories, "base": model.base, "forest": model.forest}
    elif detector.weights is not None:
        detector.weights.vocabulary.write.mode("overwrite").parquet(f"{path}/weights")
        config["intercept"] = detector.weights.intercept
    else:
        detector.pipeline.write().overwrite().save(f"{path}/model")
    row = [(detector.name, detector.kind, json.dumps(config), detector.feature_names)]
    schema = "name STRING, kind STRING, config STRING, feature_names ARRAY<STRING>"
    spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/config")


def load_detector(spark: SparkSession, path: str, encoder: Callable | None = None) -> Detector:
    row = spark.read.parquet(f"{path}/config").first()
    config = json.loads(row["config"])
    if row["kind"] == "tree":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        model = trees.TreeModel(**config.pop("model"), nodes=nodes.sort_values(["tree", "node"], ignore_index=True))
        return Detector(row["name"], row["kind"], None, config, list(row["feature_names"]), trees=model)
    if "intercept" in config:
        from cmdprism.operators.sparse_lr import TextWeights

        weights = TextWeights(spark.read.parquet(f"{path}/weights"), config.pop("intercept"), config.get("strip_accents", True))
        return Detector(row["name"], row["kind"], None, config, list(row["feature_names"]), weights=weights)
    pipeline = PipelineModel.load(f"{path}/model")
    return Detector(row["name"], row["kind"], pipeline, config, list(row["feature_names"]), encoder)


def providers_from_metadata(
    spark: SparkSession, metadata: Sequence[dict], encoders: dict[str, Callable] | None = None
) -> list[Provider]:
    """Scorers from ``{name, type, path}`` entries; an unknown type is an error."""
    out = []
    for entry in metadata:
        if entry.get("type") not in ("tree", "tfidf", "sentence"):
            raise ValueError(f"unknown provider type: {entry.get('type')}")
        detector = load_detector(spark, entry["path"], (encoders or {}).get(entry["name"]))
        detector.name = entry["name"]
        out.append(detector.provider())
    return out


# ---- tuning ------------------------------------------------------------------------------


def grid_points(model: str, grid: dict[str, list] | None = None) -> list[dict]:
    """All points of a grid, the first parameter changing slowest."""
    grid = grid or TUNING_GRIDS[model]
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def macro_f1(hits: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1 from rows (label, prediction, n); a class without rows or predictions counts 0."""

    def count(label: int, prediction: int) -> Column:
        return F.sum(F.when((F.col("label") == label) & (F.col("prediction") == prediction), F.col("n")).otherwise(0)).cast("double")

    tn, fp, fn, tp = count(0, 0), count(0, 1), count(1, 0), count(1, 1)
    # try_divide gives NULL for a class that neither stands nor is predicted.
    scores = [F.coalesce(F.try_divide(2 * t, 2 * t + fp + fn), F.lit(0.0)) for t in (tn, tp)]
    return hits.groupBy(*by).agg(((scores[0] + scores[1]) / 2).alias("macro_f1"), F.sum("n").alias("n"), (fn + tp).cast("bigint").alias("positives"))


def folded_bins(features: DataFrame, folds: int = 5) -> tuple[DataFrame, Layout]:
    """Labelled features with their stratified fold, binned once into a written table that all models can be tuned on."""
    labeled = features.where(F.col(LABEL).isNotNull())
    folded = materialize(stratified_kfold(labeled, folds, SEED), "folds")
    return binned_features(folded, "fold")[:2]


def tune(
    features: DataFrame, model: str, grid: dict[str, list] | None = None, folds: int = 5, class_weight: str | None = "balanced",
    base: dict | None = None, task_rows: int = trees.TASK_ROWS, bins: tuple[DataFrame, Layout] | None = None,
) -> DataFrame:
    """Mean macro F1 over stratified folds for every grid point, best first, with the rows that were scored.

    Features are binned once; all points and folds are grown in one pass over them (``trees``). Class weights come from the
    training part of each fold, but for ``xgb``, whose positive weight comes from all labels. ``bins``: what ``folded_bins`` gives for
    the same features and folds, so that several models share it.
    """
    if model not in TREE_MODELS:
        raise ValueError(f"unknown tree model: {model}")
    defaults = {"gbdt": GBDT_PARAMS, "xgb": BOOSTED_PARAMS, "rf": FOREST_PARAMS}[model]
    points = grid_points(model, grid)
    binned, layout = bins or folded_bins(features, folds)
    weighting: dict = {}
    if class_weight is not None:
        zero, one = (sum(c) for c in zip(*trees.label_counts(binned).values(), strict=True))
        weighting = {
            "gbdt": {"class_weight": class_weight, "is_unbalance": class_weight == "balanced"},
            "xgb": {"scale_pos_weight": zero / max(one, 1)},
            "rf": {"class_weight": "balanced_subsample"},
        }[model]
    made = [tree_params(defaults, {**weighting, **(base or {}), **point}) for point in points]
    hits = trees.held_predictions(binned, layout, made, folds, task_rows)
    per_fold = macro_f1(hits, ["point", "fold"])
    per_point = per_fold.groupBy("point").agg(
        F.avg("macro_f1").alias("avg_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1"),
        F.sum("n").alias("n_scored"), F.sum("positives").alias("positives"),
    )
    names = [(k, model, {n: str(v) for n, v in point.items()}) for k, point in enumerate(points)]
    described = features.sparkSession.createDataFrame(names, "point INT, model STRING, params MAP<STRING, STRING>")
    columns = ["model", "params", "avg_macro_f1", "std_macro_f1", "n_scored", "positives"]
    return rank_models(described.join(per_point, "point").select(*columns))


def rank_models(results: DataFrame, score: str = "avg_macro_f1") -> DataFrame:
    """Best first; equal scores by model and parameters."""
    return results.orderBy(F.col(score).desc(), "model", F.to_json("params"))


# ---- comparison --------------------------------------------------------------------------


def compare_models(scores: DataFrame, step: float = 0.05, latency: DataFrame | None = None, costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics per model with latency and cost, and the threshold sweep per model.

    ``scores`` is (model, row_id, label, score) for all models; each metric is one job over it.
    """
    table = m.full_report(scores, ["model"])
    if latency is not None:
        table = table.join(latency, "model", "left")
    if costs is not None:
        table = table.join(costs, F.lower("model") == F.col("cost_model"), "left").drop("cost_model")
    return table, m.threshold_sweep(scores, step, ["model"])


def union_scores(tables: Iterator[tuple[str, DataFrame]] | Sequence[tuple[str, DataFrame]], label: str = LABEL) -> DataFrame:
    """Per-model score tables (row_id, label, prob) as one."""
    parts = [t.select(F.lit(name).alias("model"), ROW_ID, label, F.col(f"prob_{name}").alias("score")) for name, t in tables]
    return reduce(DataFrame.unionByName, parts)


def measure_latency(name: str, scored: DataFrame, runs: int = 1) -> DataFrame:
    """One row per timed scoring run: (model, run, n_rows, seconds)."""
    rows = []
    for run in range(runs):
        start = time.perf_counter()
        n = scored.agg(F.count(f"prob_{name}")).first()[0]
        rows.append((name, run, n, time.perf_counter() - start))
    return scored.sparkSession.createDataFrame(rows, "model STRING, run INT, n_rows BIGINT, seconds DOUBLE")


def latency_stats(runs: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Average seconds in total and per row; listed models without runs get zeros."""
    stats = runs.groupBy("model").agg(
        F.avg("seconds").alias("total_seconds"),
        F.avg(F.when(F.col("n_rows") > 0, F.col("seconds") / F.col("n_rows")).otherwise(0.0)).alias("per_row_seconds"),
        F.count("*").alias("runs"),
    )
    if models is None:
        return stats
    return models.select("model").join(stats, "model", "left").fillna(0)

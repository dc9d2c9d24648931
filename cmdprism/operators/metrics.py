"""Detector metrics: confusion counts, reports, curves, threshold sweeps, calibration.

Every operator takes a scored table (label, score, optional grouping columns such as the
model name) and works on counts per distinct score or per threshold bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.functions.labels import verdict_code
from cmdprism.functions.numbers import ratio
from cmdprism.plans.prefix import running_totals, with_score_bucket
from cmdprism.session import LABEL

ALL = "_all"


def _keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def confusion_counts(
    df: DataFrame, by: list[str] = (), prediction: Column | None = None, label: str = LABEL,
    score: str = "score", threshold: float = 0.5,
) -> DataFrame:
    """TP, FP, TN, FN per group; the prediction defaults to ``score >= threshold``."""
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False)) if prediction is None else prediction == 1
    positive = F.col(label) == 1
    counts = [
        _count(hit & positive).alias("tp"),
        _count(hit & ~positive).alias("fp"),
        _count(~hit & ~positive).alias("tn"),
        _count(~hit & positive).alias("fn"),
    ]
    return df.groupBy(*by).agg(*counts)


def _f1(precision: str, recall: str) -> Column:
    total = F.col(precision) + F.col(recall)
    return F.when(total > 0, 2 * F.col(precision) * F.col(recall) / total).otherwise(0.0)


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class, macro and weighted precision/recall/F1 and accuracy from confusion counts.

    The macro average is over the classes that occur as label or as prediction.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns(
        {
            "n": tp + fp + tn + fn,
            "support_0": tn + fp,
            "support_1": tp + fn,
            "precision_0": ratio(tn, tn + fn),
            "recall_0": ratio(tn, tn + fp),
            "precision_1": ratio(tp, tp + fp),
            "recall_1": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        }
    ).withColumns({"f1_0": _f1("precision_0", "recall_0"), "f1_1": _f1("precision_1", "recall_1")})
    seen_0 = ((tn + fp + fn) > 0).cast("int")
    seen_1 = ((tp + fp + fn) > 0).cast("int")
    averages = {}
    for m in ("precision", "recall", "f1"):
        zero, one = F.col(f"{m}_0"), F.col(f"{m}_1")
        averages[f"macro_{m}"] = ratio(zero * seen_0 + one * seen_1, seen_0 + seen_1)
        averages[f"weighted_{m}"] = ratio(zero * F.col("support_0") + one * F.col("support_1"), F.col("n"))
    return out.withColumns(averages)


def _class_counts(label: str, score: str) -> list[Column]:
    """Positives and negatives with a score.

    Rows without a score are left out here and not by a filter, because a filter would be
    pushed down to the scan and run the whole scorer a second time.
    """
    present = F.col(score).isNotNull()
    return [
        _count(present & (F.col(label) == 1)).alias("p"),
        _count(present & (F.col(label) == 0)).alias("n"),
    ]


def score_counts(df: DataFrame, by: list[str], label: str = LABEL, score: str = "score") -> DataFrame:
    """Positives ``p`` and negatives ``n`` per distinct score."""
    return df.groupBy(*by, score).agg(*_class_counts(label, score)).where(F.col("p") + F.col("n") > 0)


def ranked_scores(df: DataFrame, by: list[str] = (), label: str = LABEL, score: str = "score") -> DataFrame:
    """Distinct scores with the positives and negatives scored strictly higher, and the totals."""
    keyed, keys = _keys(df, by)
    return running_totals(score_counts(keyed, keys, label, score), keys, [F.col(score).desc()], ["p", "n"], -F.col(score))


def roc_points(ranked: DataFrame, score: str = "score") -> DataFrame:
    tp, fp = F.col("p_before") + F.col("p"), F.col("n_before") + F.col("n")
    return ranked.withColumns(
        {"threshold": F.col(score), "tpr": ratio(tp, F.col("p_total")), "fpr": ratio(fp, F.col("n_total"))}
    ).drop("p", "n", "p_before", "n_before", "p_total", "n_total", score, ALL)


def pr_points(ranked: DataFrame, score: str = "score") -> DataFrame:
    tp, fp = F.col("p_before") + F.col("p"), F.col("n_before") + F.col("n")
    return ranked.withColumns(
        {"threshold": F.col(score), "precision": ratio(tp, tp + fp), "recall": ratio(tp, F.col("p_total"))}
    ).drop("p", "n", "p_before", "n_before", "p_total", "n_total", score, ALL)


def _ranking_sums() -> list[Column]:
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    tp = F.col("p_before") + F.col("p")
    fp = F.col("n_before") + F.col("n")
    precision = ratio(tp, tp + fp)
    ahead = F.col("p_before") + F.col("n_before")
    previous = F.when(ahead > 0, F.col("p_before").cast("double") / ahead.cast("double")).otherwise(1.0)
    return [
        F.sum(n * (F.col("p_before").cast("double") + p / 2)).alias("_area"),
        F.sum(p * precision).alias("_steps"),
        F.sum(p * (precision + previous) / 2).alias("_trapezoids"),
        F.sum("p").alias("_p"),
        F.sum("n").alias("_n"),
    ]


def _with_areas(sums: DataFrame) -> DataFrame:
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    areas = {
        "roc_auc": F.when(both, F.col("_area") / pairs),
        "average_precision": ratio(F.col("_steps"), F.col("_p")),
        "pr_auc": ratio(F.col("_trapezoids"), F.col("_p")),
    }
    return sums.withColumns(areas).drop("_area", "_steps", "_trapezoids", "_p", "_n")


def ranking_metrics(ranked: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC-AUC, average precision (step sum) and PR-AUC (trapezoid) per group.

    ROC-AUC is NULL where only one class occurs; without positives average precision is 0.
    """
    keys = list(by) or [ALL]
    return _with_areas(ranked.groupBy(*keys).agg(*_ranking_sums())).drop(ALL)


def threshold_grid(step: float = 0.05) -> list[float]:
    """0 to 1 in steps, rounded to three decimals, ends included."""
    count = int(1 / step) + 2
    return sorted({round(min(i * step, 1.0), 3) for i in range(count)})


def sweep_thresholds(
    df: DataFrame, thresholds: list[float], by: list[str] = (), label: str = LABEL, score: str = "score"
) -> DataFrame:
    """Confusion counts and rates at every threshold, from one pass over the scores.

    Each row falls into one bin (the number of thresholds its score reaches); a threshold's
    positives are then the rows in the bins above it. The list of bins per group is never
    longer than the list of thresholds plus one.
    """
    keyed, keys = _keys(df, by)
    thresholds = sorted(thresholds)
    binned = with_score_bucket(keyed, score, thresholds, "_bin")
    per_bin = binned.groupBy(*keys, "_bin").agg(*_class_counts(label, score))
    per_key = per_bin.groupBy(*keys).agg(
        F.collect_list(F.struct("_bin", "p", "n")).alias("_bins"), F.sum("p").alias("_p"), F.sum("n").alias("_n")
    )
    points = per_key.select(*keys, "_bins", "_p", "_n", F.posexplode(F.array(*[F.lit(t) for t in thresholds])))

    def above(field: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate("_bins", zero, lambda acc, b: acc + F.when(b["_bin"] > F.col("pos"), b[field]).otherwise(0))

    out = points.withColumnRenamed("col", "threshold").withColumns({"tp": above("p"), "fp": above("n")})
    out = out.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "fpr": ratio(fp, fp + tn),
            "tpr": ratio(tp, tp + fn),
        }
    ).drop("_bins", "_p", "_n", "pos", ALL)


def threshold_sweep(
    df: DataFrame, step: float = 0.05, by: list[str] = (), label: str = LABEL, score: str = "score"
) -> DataFrame:
    return sweep_thresholds(df, threshold_grid(step), by, label, score)


def sweep_with_calibrated(
    df: DataFrame, calibrated: float | None, step: float = 0.05, by: list[str] = (), label: str = LABEL,
    score: str = "score",
) -> DataFrame:
    """The sweep with the calibrated threshold added (unless on the grid) and marked."""
    grid = threshold_grid(step)
    if calibrated is not None and all(abs(calibrated - t) > 1e-6 for t in grid):
        grid.append(calibrated)
    marked = F.lit(False) if calibrated is None else F.abs(F.col("threshold") - calibrated) <= 1e-6
    return sweep_thresholds(df, grid, by, label, score).withColumn("is_calibrated", marked)


def grid_points(df: DataFrame, steps: int, label: str, score: str) -> DataFrame:
    """Precision and recall at ``steps + 1`` evenly spaced thresholds from 0 to 1."""
    grid = [i / steps for i in range(steps)] + [1.0]
    return sweep_thresholds(df, grid, label=label, score=score).select("threshold", "precision", "recall")


def distinct_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score, however many there are."""
    ranked = ranked_scores(df, label=label, score=score)
    return pr_points(ranked, score).select("threshold", "precision", "recall")


def calibrate_threshold(
    df: DataFrame, recall_target: float = 0.95, steps: int = 1000, label: str = LABEL, score: str = "score",
    candidates: str = "grid",
) -> DataFrame:
    """Lowest threshold of best precision among those that reach the recall target (one row).

    ``candidates`` says which thresholds are looked at: an even ``grid`` of ``steps``, or every ``distinct`` score. If
    none reaches the target, the one of best recall, then precision; if nothing is ever right, 0.5.
    """
    if candidates not in ("grid", "distinct"):
        raise ValueError(f"unknown candidates: {candidates}")
    points = distinct_points(df, label, score) if candidates == "distinct" else grid_points(df, steps, label, score)
    reached = F.col("recall") >= recall_target
    best = F.max_by(
        F.struct("threshold", "precision", "recall"),
        F.struct(reached, F.when(reached, F.lit(0.0)).otherwise(F.col("recall")), "precision", -F.col("threshold")),
    )
    picked = points.agg(best.alias("b"), F.count("*").alias("evaluated_points"))
    useful = F.coalesce((F.col("b.recall") >= recall_target) | (F.col("b.precision") > 0), F.lit(False))
    return picked.select(
        F.when(useful, F.col("b.threshold")).otherwise(0.5).alias("threshold"),
        F.when(useful, F.col("b.precision")).otherwise(0.0).alias("precision"),
        F.when(useful, F.col("b.recall")).otherwise(0.0).alias("recall"),
        F.lit(recall_target).alias("recall_target"),
        F.coalesce(F.col("b.recall") >= recall_target, F.lit(False)).alias("achieved_target"),
        "evaluated_points",
    )


def score_histogram(
    df: DataFrame, bins: int = 20, by: list[str] = (), label: str = LABEL, score: str = "score"
) -> DataFrame:
    """Counts per equal-width bin of each label's own score range; the last bin is closed."""
    keys = [*by, label]
    scored = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("_s"))
    spans = scored.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    spans = spans.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("bin_start"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("bin_start")) / bins
    raw = F.least(F.floor((F.col("_s") - F.col("bin_start")) / width), F.lit(bins - 1)).cast("int")
    start = F.col("bin_start")
    exact = (
        F.when(F.col("_s") < start + F.col("_raw") * F.col("_w"), F.col("_raw") - 1)
        .when((F.col("_raw") < bins - 1) & (F.col("_s") >= start + (F.col("_raw") + 1) * F.col("_w")), F.col("_raw") + 1)
        .otherwise(F.col("_raw"))
    )
    counted = (
        scored.join(spans, keys)
        .withColumns({"_w": width, "_raw": raw})
        .groupBy(*keys, exact.alias("bin"))
        .agg(F.count("*").alias("_n"))
    )
    empty = spans.select(*keys, "bin_start", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return empty.join(counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin_start") + F.col("bin") * width).alias("bin_left"),
        (F.col("bin_start") + (F.col("bin") + 1) * width).alias("bin_right"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_rows"),
    )


def error_rates(counts: DataFrame) -> DataFrame:
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    keys = [c for c in counts.columns if c not in ("tp", "fp", "tn", "fn")]
    return counts.select(
        *keys,
        n.alias("n"),
        ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
    )


def full_report(df: DataFrame, by: list[str] = (), label: str = LABEL, score: str = "score") -> DataFrame:
    """Report at 0.5 with ROC-AUC and average precision, one row per group.

    All numbers come from the counts per distinct score, so the events are aggregated once.
    """
    keyed, keys = _keys(df, by)
    ranked = ranked_scores(keyed, keys, label, score)
    hit = F.col(score) >= 0.5
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("tn"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
        *_ranking_sums(),
    )
    return classification_report(_with_areas(sums)).drop(ALL)


def two_valued_report(counts: DataFrame) -> DataFrame:
    """Report with ROC-AUC, average precision and PR-AUC of a verdict that is only yes or no, from confusion counts.

    Its curves have two points: at "yes" and at "all".
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    positives, negatives = tp + fn, fp + tn
    at_yes, at_all = ratio(tp, tp + fp), ratio(positives, positives + negatives)
    first = F.when(tp + fp > 0, tp).otherwise(0.0)
    return classification_report(counts).withColumns(
        {
            "roc_auc": F.when((positives > 0) & (negatives > 0), (tp * tn + (tp * fp + fn * tn) / 2) / (positives * negatives)),
            "average_precision": ratio(first * at_yes + (positives - first) * at_all, positives),
            "pr_auc": ratio(
                first * (at_yes + 1.0) / 2 + (positives - first) * (at_all + F.when(tp + fp > 0, at_yes).otherwise(1.0)) / 2, positives
            ),
        }
    )


def verdict_metrics(df: DataFrame, verdict: str, by: list[str] = (), label: str = LABEL) -> DataFrame:
    """Report of the reviewer's own verdict words against the label: one aggregate, as a word has two values."""
    code = verdict_code(F.col(verdict))
    counts = confusion_counts(df.where(F.col(label).isNotNull()), by, prediction=F.coalesce(code, F.lit(0)), label=label)
    return two_valued_report(counts)


def nearest_threshold_rows(points: DataFrame, targets: list[float], by: list[str]) -> DataFrame:
    """For each target the closest sweep row per group, the lower threshold on ties.

    A group's sweep points are few (the grid) and become one sorted array; each target picks
    its element from it, so no pair of points and targets is ever spread out as rows.
    """
    fields = [c for c in points.columns if c not in by]
    ordered = ["threshold", *[c for c in fields if c != "threshold"]]
    grids = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("_points"))
    exploded = grids.select(*by, "_points", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))

    def closer(best, point):
        gap = F.abs(point["threshold"] - F.col("target"))
        return F.when(best.isNull() | (gap < F.abs(best["threshold"] - F.col("target"))), point).otherwise(best)

    picked = F.reduce("_points", F.element_at("_points", 1), closer)
    return exploded.select(*by, "target", picked.alias("_row")).select(*by, "target", "_row.*")


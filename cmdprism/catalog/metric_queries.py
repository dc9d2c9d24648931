"""Registered queries: reports, curves, sweeps, calibration, error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdprism.catalog.registry import query
from cmdprism.catalog.scored import MODELS, score_runs, scored, stacked, with_scored
from cmdprism.catalog.telemetry import FLAG_FEATURES, table, telemetry, with_telemetry
from cmdprism.functions.features import build_features
from cmdprism.operators import errors as er
from cmdprism.operators import metrics as m
from cmdprism.plans.nearest import nearest_rows
from cmdprism.sources.tables import materialize

CONFUSION = """SELECT model,
  count(*) FILTER (WHERE score >= 0.5e0 AND "_label" = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5e0 AND "_label" = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5e0 AND "_label" = 0) AS tn,
  count(*) FILTER (WHERE score < 0.5e0 AND "_label" = 1) AS fn
FROM scored GROUP BY model"""

DIV = "CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END"


def div(a: str, b: str) -> str:
    return DIV.format(a=a, b=f"({b})")


REPORT_COLUMNS = [
    "accuracy", "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "macro_precision",
    "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1",
]
REPORT = f"""SELECT r.*, {', '.join(
    f"{div(f'{x}_0 * s0 + {x}_1 * s1', 's0 + s1')} AS macro_{x}, "
    f"{div(f'{x}_0 * support_0 + {x}_1 * support_1', 'n')} AS weighted_{x}" for x in ("precision", "recall", "f1")
)} FROM (SELECT *, {', '.join(
    f"{div(f'2 * precision_{c} * recall_{c}', f'precision_{c} + recall_{c}')} AS f1_{c}" for c in (0, 1)
)} FROM (SELECT *, tp + fp + tn + fn AS n, tn + fp AS support_0, tp + fn AS support_1,
  CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END AS s0, CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END AS s1,
  {div('tn', 'tn + fn')} AS precision_0, {div('tn', 'tn + fp')} AS recall_0,
  {div('tp', 'tp + fp')} AS precision_1, {div('tp', 'tp + fn')} AS recall_1,
  {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM confusion)) r"""


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def big(df, *columns):
    """Ranks and bins as BIGINT, the type of the twins."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def rounded_sql(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("e13_confusion_counts", with_scored(CONFUSION))
def e13_confusion_counts(spark, sf_dir):
    return m.confusion_counts(scored(spark, sf_dir), ["model"])


@query(
    "e14_classification_report",
    with_scored(
        f"SELECT model, n, support_0, support_1, {rounded_sql(REPORT_COLUMNS)} FROM report",
        ("confusion", CONFUSION),
        ("report", REPORT),
    ),
)
def e14_classification_report(spark, sf_dir):
    report = m.classification_report(m.confusion_counts(scored(spark, sf_dir), ["model"]))
    return rounded(report, REPORT_COLUMNS).select("model", "n", "support_0", "support_1", *REPORT_COLUMNS)


@query(
    "e15_error_rates",
    with_scored(
        f"""SELECT model, tp + fp + tn + fn AS n, round({div('tp + tn', 'tp + fp + tn + fn')}, 6) AS accuracy,
  fp AS false_positives, fn AS false_negatives FROM confusion""",
        ("confusion", CONFUSION),
    ),
)
def e15_error_rates(spark, sf_dir):
    return rounded(m.error_rates(m.confusion_counts(scored(spark, sf_dir), ["model"])), ["accuracy"])


def shape_errors(spark, sf_dir):
    """Telemetry features with the error type of the ``shape`` scorer.

    The scored features are written first: a filter on the error type would otherwise be
    pushed down to the scan together with all feature expressions it depends on.
    """
    rows = stacked(spark, sf_dir).withColumn("score", F.round("prob_shape", 6))
    return er.with_error_type(materialize(rows, "scored-features"))


ERRORS_SQL = """SELECT *, CASE WHEN p = 1 AND "_label" = 0 THEN 'FP' WHEN p = 0 AND "_label" = 1 THEN 'FN' END AS error_type
FROM (SELECT * REPLACE (round(prob_shape, 6) AS score), CASE WHEN round(prob_shape, 6) >= 0.5e0 THEN 1 ELSE 0 END AS p
  FROM stacked)"""


@query(
    "e16_error_clusters",
    with_scored(
        """SELECT * FROM (SELECT error_type, source_image_base, count(*) AS n_rows,
  row_number() OVER (PARTITION BY error_type ORDER BY count(*) DESC, source_image_base) AS rank
  FROM errors WHERE error_type IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3""",
        ("errors", ERRORS_SQL),
    ),
)
def e16_error_clusters(spark, sf_dir):
    return big(er.error_clusters(shape_errors(spark, sf_dir)), "rank")


@query(
    "e17_error_flag_totals",
    with_scored(
        "SELECT error_type, flag, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY total DESC, i)"
        " AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT error_type, {i} AS i, '{f}' AS flag, sum({f}) AS total FROM errors WHERE error_type IS NOT NULL GROUP BY 1"
            for i, f in enumerate(FLAG_FEATURES)
        )
        + ")) WHERE rank <= 5",
        ("errors", ERRORS_SQL),
    ),
)
def e17_error_flag_totals(spark, sf_dir):
    return big(er.error_flag_totals(shape_errors(spark, sf_dir)), "rank")


@query(
    "e18_error_examples",
    with_scored(
        """SELECT error_type, rank, row_id, substr(coalesce("CommandLine", ''), 1, 120) AS command_short,
  printf('%.3f', score) AS score_short FROM (
  SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY row_id) AS rank FROM errors WHERE error_type IS NOT NULL)
WHERE rank <= 3""",
        ("errors", ERRORS_SQL),
    ),
)
def e18_error_examples(spark, sf_dir):
    from cmdprism.operators.ingest import display_columns

    examples = display_columns(er.error_examples(shape_errors(spark, sf_dir)))
    return big(examples, "rank").select("error_type", "rank", "row_id", "command_short", "score_short")


@query(
    "d3_predictions_with_features",
    with_scored(
        """SELECT s.model, s.row_id, s.score, f.cmd_length, f.source_image_base, f.has_cmd
FROM scored s LEFT JOIN features f USING (row_id)"""
    ),
)
def d3_predictions_with_features(spark, sf_dir):
    features = build_features(telemetry(spark, sf_dir))
    joined = er.attach_features(scored(spark, sf_dir), features, ["cmd_length", "source_image_base", "has_cmd"])
    return joined.select("model", "row_id", "score", "cmd_length", "source_image_base", "has_cmd")


@query(
    "d4_errors_with_text",
    with_scored(
        """SELECT row_id, error_type, "CommandLine" AS command_line, "SourceImage" AS source_image
FROM errors WHERE error_type IS NOT NULL""",
        ("errors", ERRORS_SQL),
    ),
)
def d4_errors_with_text(spark, sf_dir):
    errors = shape_errors(spark, sf_dir).select("row_id", "error_type")
    joined = er.attach_text(errors, telemetry(spark, sf_dir), ["CommandLine", "SourceImage"])
    return joined.withColumnsRenamed({"CommandLine": "command_line", "SourceImage": "source_image"})


CURVE = """SELECT model, score, p, n,
  CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
  CAST(sum(p) OVER (PARTITION BY model) AS BIGINT) AS pt, CAST(sum(n) OVER (PARTITION BY model) AS BIGINT) AS nt
FROM (SELECT model, score, count(*) FILTER (WHERE "_label" = 1) AS p, count(*) FILTER (WHERE "_label" = 0) AS n
  FROM scored GROUP BY 1, 2)
WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""


@query(
    "f1_roc_points",
    with_scored(
        f"""SELECT model, score AS threshold, round({div('tp', 'pt')}, 6) AS tpr, round({div('fp', 'nt')}, 6) AS fpr FROM curve""",
        ("curve", CURVE),
    ),
)
def f1_roc_points(spark, sf_dir):
    return rounded(m.roc_points(m.ranked_scores(score_runs(spark, sf_dir), ["model"])), ["tpr", "fpr"])


@query(
    "f2_roc_auc",
    with_scored(
        """SELECT model, round(sum(CAST(n AS DOUBLE) * (tp - p + p / 2e0)) / (any_value(pt) * CAST(any_value(nt) AS DOUBLE)), 6)
  AS roc_auc FROM curve GROUP BY model""",
        ("curve", CURVE),
    ),
)
def f2_roc_auc(spark, sf_dir):
    ranking = m.ranking_metrics(m.ranked_scores(score_runs(spark, sf_dir), ["model"]), ["model"])
    return ranking.select("model", F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "f3_pr_points",
    with_scored(
        f"""SELECT model, score AS threshold, round({div('tp', 'tp + fp')}, 6) AS "precision",
  round({div('tp', 'pt')}, 6) AS recall FROM curve""",
        ("curve", CURVE),
    ),
)
def f3_pr_points(spark, sf_dir):
    return rounded(m.pr_points(m.ranked_scores(score_runs(spark, sf_dir), ["model"])), ["precision", "recall"])


@query(
    "f3_pr_auc",
    with_scored(
        """SELECT model, round(sum((r - lag_r) * (q + lag_q) / 2e0), 6) AS pr_auc FROM (
  SELECT model, r, q, lag(r, 1, 0e0) OVER w AS lag_r, lag(q, 1, 1e0) OVER w AS lag_q FROM (
    SELECT model, score, CAST(tp AS DOUBLE) / pt AS r, CAST(tp AS DOUBLE) / (tp + fp) AS q FROM curve)
  WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model""",
        ("curve", CURVE),
    ),
)
def f3_pr_auc(spark, sf_dir):
    ranking = m.ranking_metrics(m.ranked_scores(score_runs(spark, sf_dir), ["model"]), ["model"])
    return ranking.select("model", F.round("pr_auc", 6).alias("pr_auc"))


@query(
    "f4_average_precision",
    with_scored(
        """SELECT model, round(sum(CAST(p AS DOUBLE) / pt * tp / (tp + fp)), 6) AS average_precision
FROM curve GROUP BY model""",
        ("curve", CURVE),
    ),
)
def f4_average_precision(spark, sf_dir):
    ranking = m.ranking_metrics(m.ranked_scores(score_runs(spark, sf_dir), ["model"]), ["model"])
    return ranking.select("model", F.round("average_precision", 6).alias("average_precision"))


RATES = ["precision", "recall", "fpr", "tpr"]


def sweep_sql(grid: str, keys: str = "model, ") -> str:
    """Every threshold against every score: the plain definition."""
    group = f"{keys}threshold"
    return f"""SELECT {keys}threshold, tp, fp, tn, fn, {div('tp', 'tp + fp')} AS "precision", {div('tp', 'tp + fn')} AS recall,
  {div('fp', 'fp + tn')} AS fpr, {div('tp', 'tp + fn')} AS tpr FROM (
  SELECT {group}, count(*) FILTER (WHERE score >= threshold AND "_label" = 1) AS tp,
    count(*) FILTER (WHERE score >= threshold AND "_label" = 0) AS fp,
    count(*) FILTER (WHERE score < threshold AND "_label" = 0) AS tn,
    count(*) FILTER (WHERE score < threshold AND "_label" = 1) AS fn
  FROM scored, ({grid}) GROUP BY ALL)"""


GRID = "SELECT round(i * 0.05e0, 3) AS threshold FROM range(0, 21) t(i)"


def rounded_points(df):
    return rounded(df, RATES)


RATES_SQL = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr'


@query(
    "f5_threshold_sweep",
    with_scored(f"SELECT model, threshold, tp, fp, tn, fn, {RATES_SQL} FROM ({sweep_sql(GRID)})"),
)
def f5_threshold_sweep(spark, sf_dir):
    return rounded_points(m.threshold_sweep(scored(spark, sf_dir), by=["model"]))


@query(
    "f6_sweep_with_calibrated",
    with_scored(
        f"""SELECT model, threshold, tp, fp, tn, fn, {RATES_SQL}, threshold = 0.4321e0 AS is_calibrated
FROM ({sweep_sql(GRID + ' UNION ALL SELECT 0.4321e0')})"""
    ),
)
def f6_sweep_with_calibrated(spark, sf_dir):
    return rounded_points(m.sweep_with_calibrated(scored(spark, sf_dir), 0.4321, by=["model"]))


CALIBRATE = """SELECT round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  TRUE AS achieved_target, evaluated_points
FROM (SELECT *, count(*) OVER () AS evaluated_points FROM points) WHERE recall >= 0.95e0
ORDER BY "precision" DESC, threshold LIMIT 1"""
FINE_GRID = "SELECT CASE WHEN i = 400 THEN 1e0 ELSE i * 0.0025e0 END AS threshold FROM range(0, 401) t(i)"


def calibrated(df, candidates):
    out = m.calibrate_threshold(df, 0.95, 400, candidates=candidates)
    return rounded(out, ["threshold", "precision", "recall"]).select(
        "threshold", "precision", "recall", "achieved_target", "evaluated_points"
    )


@query(
    "f7_calibrate_grid",
    with_telemetry(CALIBRATE, ("scored", 'SELECT score, "_label" FROM telemetry'), ("points", sweep_sql(FINE_GRID, ""))),
)
def f7_calibrate_grid(spark, sf_dir):
    """The candidates are an even grid."""
    return calibrated(telemetry(spark, sf_dir), "grid")


@query(
    "f7_calibrate_distinct",
    with_scored(
        f"""SELECT model, round(score, 6) AS threshold, round({div('tp', 'tp + fp')}, 6) AS "precision", round({div('tp', 'pt')}, 6) AS recall,
  TRUE AS achieved_target, evaluated_points FROM (
  SELECT *, count(*) OVER (PARTITION BY model) AS evaluated_points FROM curve) WHERE {div('tp', 'pt')} >= 0.95e0
QUALIFY row_number() OVER (PARTITION BY model ORDER BY {div('tp', 'tp + fp')} DESC, score) = 1""",
        ("curve", CURVE),
    ),
)
def f7_calibrate_distinct(spark, sf_dir):
    """Every distinct score is a candidate, for each model."""
    scores = score_runs(spark, sf_dir)
    parts = [calibrated(scores.where(F.col("model") == name), "distinct").withColumn("model", F.lit(name)) for name in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "f8_score_histogram",
    with_scored(
        """SELECT model, "_label", bin, round(lo + bin * w, 6) AS bin_left, round(lo + (bin + 1) * w, 6) AS bin_right,
  count(*) FILTER (WHERE score >= lo + bin * w AND (score < lo + (bin + 1) * w OR bin = 19)) AS n_rows
FROM (SELECT model, "_label", CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo,
    CASE WHEN lo = hi THEN 1e0 ELSE hi - lo END / 20 AS w FROM (
    SELECT model, "_label", min(score) AS lo, max(score) AS hi FROM scored GROUP BY 1, 2))
CROSS JOIN range(0, 20) t(bin) JOIN scored s USING (model, "_label")
GROUP BY model, "_label", bin, lo, w"""
    ),
)
def f8_score_histogram(spark, sf_dir):
    return big(rounded(m.score_histogram(scored(spark, sf_dir), by=["model"]), ["bin_left", "bin_right"]), "bin")


@query(
    "f9_top_scores",
    with_scored(
        """SELECT model, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, row_id)
  AS rank FROM scored) WHERE rank <= 10"""
    ),
)
def f9_top_scores(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("model").orderBy(F.col("score").desc(), "row_id")
    ranked = scored(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 10)
    return big(ranked, "rank").select("model", "row_id", "score", "rank")


@query(
    "d11_nearest_threshold_rows",
    with_scored(
        f"""SELECT model, target, threshold, tp, fp, tn, fn, {RATES_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY abs(threshold - target), threshold) AS r
  FROM points, (SELECT i / 10e0 AS target FROM range(1, 10) t(i))) WHERE r = 1""",
        ("points", sweep_sql("SELECT least(round(i * 0.07e0, 3), 1e0) AS threshold FROM range(0, 16) t(i)")),
    ),
)
def d11_nearest_threshold_rows(spark, sf_dir):
    points = m.threshold_sweep(scored(spark, sf_dir), step=0.07, by=["model"])
    picked = m.nearest_threshold_rows(points, [round(i / 10, 1) for i in range(1, 10)], ["model"])
    return rounded_points(picked)


@query(
    "d11_nearest_orders",
    """SELECT event_id, CASE WHEN a.v IS NULL OR b.v - e.v < e.v - a.v THEN b.k ELSE a.k END AS o_orderkey,
  CASE WHEN a.v IS NULL OR b.v - e.v < e.v - a.v THEN b.v ELSE a.v END AS price
FROM (SELECT event_id, user_id % 7 AS g, value * 1e3 AS v FROM events) e
ASOF LEFT JOIN (SELECT o_custkey % 7 AS g, CAST(o_totalprice AS DOUBLE) AS v, min(o_orderkey) AS k FROM orders GROUP BY ALL) a ON e.g = a.g AND e.v >= a.v
ASOF LEFT JOIN (SELECT o_custkey % 7 AS g, CAST(o_totalprice AS DOUBLE) AS v, min(o_orderkey) AS k FROM orders GROUP BY ALL) b ON e.g = b.g AND e.v <= b.v""",
)
def d11_nearest_orders(spark, sf_dir):
    """For every event the order of its group with the closest total price: both sides are whole tables."""
    events = table(spark, sf_dir, "events", ["event_id", "user_id", "value"])
    events = events.select("event_id", (F.col("user_id") % 7).alias("g"), (F.col("value") * 1e3).alias("v"))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    orders = orders.select((F.col("o_custkey") % 7).alias("g"), F.col("o_totalprice").cast("double").alias("v"), "o_orderkey")
    found = nearest_rows(orders, events, "v", ["g"])
    return found.select("event_id", F.col("nearest.o_orderkey").alias("o_orderkey"), F.col("nearest.v").alias("price"))


@query(
    "e20_verdict_metrics",
    with_telemetry(
        f"""SELECT n, support_0, support_1, {rounded_sql(REPORT_COLUMNS)}, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision
FROM report, (SELECT tp / (tp + fn) * tn / (fp + tn) + (tp / (tp + fn) * fp / (fp + tn) + fn / (tp + fn) * tn / (fp + tn)) / 2e0 AS auc,
  tp / (tp + fn) * tp / (tp + fp) + fn / (tp + fn) * (tp + fn) / (tp + fp + tn + fn) AS ap FROM
  (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn FROM confusion))""",
        ("scored", """SELECT 1 AS model, CASE WHEN lower(verdict_label) = 'malicious' THEN 1e0 ELSE 0e0 END AS score, "_label" FROM telemetry"""),
        ("confusion", CONFUSION),
        ("report", REPORT),
    ),
)
def e20_verdict_metrics(spark, sf_dir):
    columns = [*REPORT_COLUMNS, "roc_auc", "average_precision"]
    report = rounded(m.verdict_metrics(telemetry(spark, sf_dir), "verdict_label"), columns)
    return report.select("n", "support_0", "support_1", *columns)

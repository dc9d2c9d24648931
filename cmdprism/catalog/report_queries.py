"""Registered queries: lookups, explanations, instruction records, prompts and parsers, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdprism.catalog.ingest_queries import documents
from cmdprism.catalog.metric_queries import CONFUSION, CURVE, GRID, REPORT, rounded, rounded_sql, sweep_sql
from cmdprism.catalog.registry import query
from cmdprism.catalog.scored import STACKED_SQL, WEIGHTS, score_runs, stacked, with_scored
from cmdprism.catalog.split_queries import ASSIGNED, GROUPS, KEYED, STATS
from cmdprism.catalog.telemetry import feature_sql, table, telemetry, with_features, with_telemetry
from cmdprism.functions import payloads as pl
from cmdprism.functions import signals as sg
from cmdprism.functions import text as tx
from cmdprism.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, build_features
from cmdprism.operators import corpus as cp
from cmdprism.operators import costs as co
from cmdprism.operators import explain as ex
from cmdprism.operators import lookups as lk
from cmdprism.operators import metrics as m
from cmdprism.operators import models as md
from cmdprism.operators import splits as sp
from cmdprism.operators.ingest import add_group_key
from cmdprism.session import scratch_path
from cmdprism.sources import events as ev
from cmdprism.sources.tables import materialize


def js(c: str) -> str:
    """SQL for the JSON text of a string expression (the supplied texts hold no other control characters)."""
    body = f"replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    for code, mark in ((9, "t"), (10, "n"), (13, "r")):
        body = f"replace({body}, chr({code}), chr(92) || '{mark}')"
    return f"coalesce('\"' || {body} || '\"', 'null')"


def judged(spark, sf_dir):
    """Telemetry with the reviewer's verdict as JSON text."""
    t = telemetry(spark, sf_dir)
    parts = {
        "predicted_label": tx.json_string(F.col("verdict_label")),
        "reason": tx.json_string(F.col("verdict_reason")),
        "confidence": tx.json_string(F.col("verdict_confidence")),
    }
    return t.withColumn("verdict_json", F.when(F.col("verdict_label").isNotNull(), tx.json_object(parts)))


JUDGED = f"""SELECT *, CASE WHEN verdict_label IS NOT NULL THEN concat('{{"predicted_label": ', {js('verdict_label')},
  ', "reason": ', {js('verdict_reason')}, ', "confidence": ', {js('verdict_confidence')}, '}}') END AS verdict_json FROM telemetry"""


def with_judged(body: str, *extra: tuple[str, str]) -> str:
    return with_telemetry(body, ("judged", JUDGED), *extra)


# ---- lookups -----------------------------------------------------------------------------


def outside_predictions(spark, sf_dir):
    """One or two predictions per event, as an outside scorer would deliver them."""
    t = telemetry(spark, sf_dir)
    first = t.select(
        "row_id", F.lit(0).alias("seq"), F.col("verdict_label").alias("label"), F.lit("0.99").alias("confidence"),
        F.lit(False).alias("is_number"),
    )
    again = t.where(F.col("row_id") % 3 == 0).select(
        "row_id", F.lit(1).alias("seq"), F.lit("Malicious").alias("label"), F.round("score", 4).cast("string").alias("confidence"),
        F.lit(True).alias("is_number"),
    )
    return first.unionByName(again)


@query(
    "d5_attach_predictions",
    with_telemetry(
        """SELECT row_id, "_label", round(CASE WHEN row_id % 3 = 0 THEN round(score, 4)
  WHEN lower(verdict_label) = 'malicious' THEN 1e0 ELSE 0e0 END, 4) AS prob FROM telemetry"""
    ),
)
def d5_attach_predictions(spark, sf_dir):
    events = telemetry(spark, sf_dir).select("row_id", "_label")
    joined = lk.attach_predictions(events, outside_predictions(spark, sf_dir), "seq")
    prob = lk.prediction_to_prob(F.col("label"), F.col("confidence"), F.col("is_number"))
    return joined.select("row_id", "_label", F.round(prob, 4).alias("prob"))


@query(
    "d5_missing_predictions",
    "SELECT doc_id AS row_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def d5_missing_predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return lk.missing_predictions(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")))


def review_predictions(spark, sf_dir):
    """Predictions of the keyword scorer; every fourth brings its own prompt, every ninth has no event."""
    t = stacked(spark, sf_dir)
    rid = F.col("row_id")
    return t.select(
        F.when(rid % 9 == 0, rid + 100_000_000).otherwise(rid).alias("row_id"),
        F.when(F.col("prob_keyword") >= 0.5, "malicious").otherwise("benign").alias("label"),
        F.round("prob_keyword", 6).alias("score"),
        F.when(rid % 4 == 0, F.concat(F.lit("own prompt "), rid.cast("string"))).otherwise("").alias("prompt"),
        F.when(rid % 2 == 0, F.lit("keyword weights")).alias("llm_reason"),
        F.lit("linear score").alias("explanation"),
    )


REVIEW_PREDICTIONS = """SELECT CASE WHEN row_id % 9 = 0 THEN row_id + 100000000 ELSE row_id END AS row_id,
  CASE WHEN prob_keyword >= 0.5e0 THEN 'malicious' ELSE 'benign' END AS label, round(prob_keyword, 6) AS score,
  CASE WHEN row_id % 4 = 0 THEN concat('own prompt ', row_id) END AS prompt,
  CASE WHEN row_id % 2 = 0 THEN 'keyword weights' ELSE 'linear score' END AS llm_reason FROM stacked"""
REVIEWS = """SELECT p.row_id, j."CommandLine" AS cmd, j."SourceImage" AS image, coalesce(p.prompt, j.prompt) AS prompt,
  j.verdict_json, j.verdict_label, j."_label" AS ground_truth, p.label, p.score, p.llm_reason
FROM predictions p LEFT JOIN judged j ON p.row_id = j.row_id"""


def with_reviews(body: str) -> str:
    return with_scored(body, ("judged", JUDGED), ("predictions", REVIEW_PREDICTIONS), ("reviews", REVIEWS))


@query("d6_build_review_inputs", with_reviews("SELECT * FROM reviews"))
def d6_build_review_inputs(spark, sf_dir):
    inputs = lk.build_review_inputs(review_predictions(spark, sf_dir), judged(spark, sf_dir))
    return inputs.select(
        "row_id", F.col("CommandLine").alias("cmd"), F.col("SourceImage").alias("image"), "prompt", "verdict_json",
        "verdict_label", "ground_truth", "prediction.label", "prediction.score", "prediction.llm_reason",
    )


@query(
    "d7_attach_reasons",
    with_telemetry(
        """SELECT row_id, CASE WHEN "_label" = 1 THEN 'malicious' ELSE 'benign' END AS label,
  CASE WHEN trim(coalesce(verdict_reason, '')) = '' THEN 'No explanation generated.' ELSE trim(verdict_reason) END AS llm_reason
FROM telemetry"""
    ),
)
def d7_attach_reasons(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    base = t.select("row_id", F.when(F.col("_label") == 1, "malicious").otherwise("benign").alias("label"))
    reasons = t.select("row_id", pl.reason_or_default(F.col("verdict_reason")).alias("llm_reason"))
    return lk.attach_reasons(base, reasons)


@query(
    "e21_null_safe_groups",
    with_telemetry("""SELECT coalesce("CommandLine", '') = '' AS no_command, "_label", count(*) AS n_rows,
  count(DISTINCT coalesce("_attack_technique", '')) AS techniques FROM telemetry GROUP BY ALL"""),
)
def e21_null_safe_groups(spark, sf_dir):
    empty = tx.text_or_empty(F.col("CommandLine")) == ""
    technique = tx.text_or_empty(F.col("_attack_technique"))
    per_value = telemetry(spark, sf_dir).groupBy(empty.alias("no_command"), "_label", technique.alias("t")).agg(F.count("*").alias("n"))
    return per_value.groupBy("no_command", "_label").agg(F.sum("n").alias("n_rows"), F.count("*").alias("techniques"))


# ---- explanations ------------------------------------------------------------------------


def signals_sql(c: str = "") -> str:
    flags = ", ".join(f"CASE WHEN {f} >= 0.5e0 THEN '{t}' END" for f, t in sg.FLAG_TEXTS.items())
    numbers = ", ".join(
        f"CASE WHEN {f} >= {limit} THEN concat('{before}', printf('%.{digits}f', CAST({f} AS DOUBLE)), '{after}') END"
        for f, limit, before, after, digits, _ in sg.NUMERIC_SIGNALS
    )
    return f"list_filter([{flags}, {numbers}], lambda x: x IS NOT NULL)"


@query(
    "i1_build_signals",
    f"""SELECT doc_id, array_to_string({signals_sql()}, '; ') AS signals FROM (
{feature_sql("documents", "text", "source", "doc_id")})""",
)
def i1_build_signals(spark, sf_dir):
    out = ex.with_signals(build_features(documents(spark, sf_dir)))
    return out.select("doc_id", F.array_join("signals", "; ").alias("signals"))


@query(
    "i2_top_signals",
    with_features(f"SELECT row_id, array_to_string(({signals_sql()})[1:3], '; ') AS signals FROM features"),
)
def i2_top_signals(spark, sf_dir):
    out = ex.with_signals(build_features(telemetry(spark, sf_dir)), 3)
    return out.select("row_id", F.array_join("signals", "; ").alias("signals"))


@query(
    "i3_feature_phrase",
    with_features(
        """SELECT name, CASE name WHEN 'has_cmd' THEN 'Explicit cmd.exe chaining' WHEN 'cmd_length' THEN 'Long command strings'
  WHEN 'cmd_exe_base' THEN 'Command entry point' WHEN 'custom' THEN 'custom'
  ELSE concat('Source executable is ', substr(name, 19)) END AS phrase, count(*) AS n_rows FROM (
  SELECT CASE row_id % 5 WHEN 0 THEN 'has_cmd' WHEN 1 THEN 'cmd_length' WHEN 2 THEN 'cmd_exe_base' WHEN 3 THEN 'custom'
    ELSE concat('source_image_base_', source_image_base) END AS name FROM features) GROUP BY ALL"""
    ),
)
def i3_feature_phrase(spark, sf_dir):
    n = F.col("row_id") % 5
    name = (
        F.when(n == 0, "has_cmd").when(n == 1, "cmd_length").when(n == 2, "cmd_exe_base").when(n == 3, "custom")
        .otherwise(F.concat(F.lit("source_image_base_"), "source_image_base"))
    )
    named = build_features(telemetry(spark, sf_dir)).select(name.alias("name"))
    return named.groupBy("name", sg.feature_phrase(F.col("name")).alias("phrase")).agg(F.count("*").alias("n_rows"))


SHAPE_WEIGHTS = WEIGHTS["shape"][0]
MEANS = "SELECT " + ", ".join(f"avg({f}) AS mean_{f}" for f in SHAPE_WEIGHTS) + " FROM features"
PHRASES = {**sg.FLAG_TEXTS, **{s[0]: s[5] for s in sg.NUMERIC_SIGNALS}}
IMPACTS = " UNION ALL ".join(
    f"SELECT row_id, {i} AS i, '{f}' AS feature, '{PHRASES[f]}' AS phrase, ({f} - mean_{f}) * {w!r}e0 AS impact FROM stacked, means"
    for i, (f, w) in enumerate(SHAPE_WEIGHTS.items())
)
TOP_IMPACTS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(impact) DESC, i) AS rank
  FROM impacts WHERE abs(impact) >= 1e-4) WHERE rank <= 3"""


def with_impacts(body: str, *extra: tuple[str, str]) -> str:
    parts = (("means", MEANS), ("impacts", IMPACTS), ("top_impacts", TOP_IMPACTS))
    return with_features(body, ("stacked", STACKED_SQL), *parts, *extra)


def contributed(spark, sf_dir):
    """Telemetry scored by the ``shape`` weights, with the exact impacts of its features."""
    rows = stacked(spark, sf_dir)
    means = ex.feature_means(rows, list(SHAPE_WEIGHTS))
    return ex.linear_contributions(rows, SHAPE_WEIGHTS, means)


@query(
    "i4_linear_contributions",
    with_impacts("SELECT row_id, rank, feature, phrase, round(impact, 6) AS impact FROM top_impacts"),
)
def i4_linear_contributions(spark, sf_dir):
    items = contributed(spark, sf_dir).select("row_id", F.posexplode("contributions").alias("pos", "c"))
    return items.select("row_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "c.feature", "c.phrase", F.round("c.impact", 6).alias("impact"))


def attributed(spark, sf_dir, train, method, margin):
    """Whether impacts and base add up to every row's output, and how many impacts are reported. The features are computed once."""
    features = build_features(telemetry(spark, sf_dir)).select("row_id", "_label", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)
    features = materialize(features, "features")
    out, base = ex.tree_contributions(train(features), features, 1000, method)
    total = F.aggregate("contributions", F.lit(base), lambda acc, c: acc + c["impact"])
    # Impacts below the reporting limit are left out, so the sum may be off by as much for each feature.
    limit = ex.MIN_IMPACT * 40
    return out.select(
        "row_id", F.col("score").between(0, 1).alias("in_range"), (F.abs(total - margin) <= limit).alias("adds_up"),
        (F.size("contributions") > 0).alias("explained"),
    )


ATTRIBUTED_SQL = with_telemetry("SELECT row_id, TRUE AS in_range, TRUE AS adds_up, TRUE AS explained FROM telemetry")


@query("i4_tree_contributions", ATTRIBUTED_SQL)
def i4_tree_contributions(spark, sf_dir):
    """Shapley values of leaf-wise boosted trees add up to every row's margin."""
    return attributed(spark, sf_dir, md.train_gbdt, "shapley", F.log(F.col("score") / (1 - F.col("score"))))


@query("i4_path_contributions", ATTRIBUTED_SQL)
def i4_path_contributions(spark, sf_dir):
    """Credits along the decision paths of a forest add up to every row's score."""
    return attributed(spark, sf_dir, md.train_random_forest, "path", F.col("score"))


# One split by hand: the impact of the only feature is the leaf's value minus the mean, both from counts of the labels.
STUMP_SQL = with_features(
    """SELECT row_id, round(CASE WHEN has_certutil > 0 THEN high ELSE low END - mean, 4) AS impact FROM features, (
  SELECT 0.1e0 * (o1 - n1 * q) / (n1 * q * (1 - q)) AS high, 0.1e0 * (o0 - n0 * q) / (n0 * q * (1 - q)) AS low,
    (n1 * (0.1e0 * (o1 - n1 * q) / (n1 * q * (1 - q))) + n0 * (0.1e0 * (o0 - n0 * q) / (n0 * q * (1 - q)))) / (n0 + n1) AS mean FROM (
    SELECT *, (o0 + o1) / CAST(n0 + n1 AS DOUBLE) AS q FROM (
      SELECT sum(CASE WHEN has_certutil > 0 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN has_certutil > 0 THEN 0 ELSE 1 END) AS n0,
        sum(CASE WHEN has_certutil > 0 THEN "_label" ELSE 0 END) AS o1, sum(CASE WHEN has_certutil > 0 THEN 0 ELSE "_label" END) AS o0 FROM features)))"""
)


@query("i4_stump_impacts", STUMP_SQL)
def i4_stump_impacts(spark, sf_dir):
    """Shapley values of one split over one flag, all other features held constant."""
    features = build_features(telemetry(spark, sf_dir))
    others = {n: F.lit(0.0) for n in NUMERIC_FEATURES if n != "has_certutil"} | {n: F.lit("same") for n in CATEGORICAL_FEATURES}
    plain = features.withColumns(others)
    detector = md.train_gbdt(plain, {"n_estimators": 1, "num_leaves": 2, "learning_rate": 0.1, "colsample_bytree": 1.0})
    out, _ = ex.tree_contributions(detector, plain, 1)
    return out.select("row_id", F.round(F.col("contributions")[0]["impact"], 4).alias("impact"))


@query(
    "i5_explain",
    with_impacts(
        f"""SELECT row_id, CASE WHEN shown >= 0.5e0 THEN 'malicious' ELSE 'benign' END AS label, shown AS score,
  array_to_string(({signals_sql()})[1:3], '; ') AS signals,
  CASE WHEN shown >= 0.5e0 AND pushes IS NOT NULL THEN concat('Model score ', printf('%.2f', shown), ' driven by ', pushes, '.')
    WHEN shown >= 0.5e0 AND len({signals_sql()}) > 0 THEN concat('Flagged due to: ', array_to_string(({signals_sql()})[1:3], ', '), '.')
    WHEN shown >= 0.5e0 THEN 'Flagged by the GBDT model despite no discrete heuristics firing.'
    WHEN pushes IS NOT NULL THEN concat('Predicted benign (', printf('%.2f', shown), '); biggest pushes were ', pushes, ' toward benign.')
    ELSE 'Predicted benign; no high-risk features triggered.' END AS explanation
FROM (SELECT *, round(prob_shape, 6) AS shown FROM stacked)
LEFT JOIN (SELECT row_id, string_agg(concat(phrase, ' (', printf('%+.2f', round(impact, 6)), ')'), ', ' ORDER BY rank) AS pushes
  FROM top_impacts GROUP BY 1) USING (row_id)"""
    ),
)
def i5_explain(spark, sf_dir):
    rows = contributed(spark, sf_dir).withColumn("score", F.round("prob_shape", 6))
    exact = F.transform(
        "contributions",
        lambda c: F.struct(c["feature"].alias("feature"), c["phrase"].alias("phrase"), c["value"].alias("value"), F.round(c["impact"], 6).alias("impact")),
    )
    out = ex.explain(rows.withColumn("contributions", exact))
    return out.select("row_id", "label", "score", F.array_join("signals", "; ").alias("signals"), "explanation")


@query(
    "i5_explain_without_contributions",
    with_features(
        f"""SELECT row_id, CASE WHEN shown >= 0.4e0 AND len({signals_sql()}) > 0
    THEN concat('Flagged due to: ', array_to_string(({signals_sql()})[1:2], ', '), '.')
    WHEN shown >= 0.4e0 THEN 'Flagged by the GBDT model despite no discrete heuristics firing.'
    ELSE 'Predicted benign; no high-risk features triggered.' END AS explanation
FROM (SELECT *, round(prob_value, 6) AS shown FROM stacked)""",
        ("stacked", STACKED_SQL),
    ),
)
def i5_explain_without_contributions(spark, sf_dir):
    rows = stacked(spark, sf_dir).withColumn("score", F.round("prob_value", 6))
    return ex.explain(rows, threshold=0.4, top_k=2).select("row_id", "explanation")


@query(
    "i6_export_explanations",
    with_scored(
        """SELECT j.row_id, round(prob_keyword, 6) AS score, CASE WHEN prob_keyword >= 0.5e0 THEN 'malicious' ELSE 'benign' END AS label,
  j."CommandLine" AS cmd, j."_label", j.verdict_json FROM judged j JOIN stacked USING (row_id)""",
        ("judged", JUDGED),
    ),
)
def i6_export_explanations(spark, sf_dir):
    rows = stacked(spark, sf_dir).withColumn("score", F.col("prob_keyword"))
    path = scratch_path(spark, "explanations")
    ev.write_jsonl(ex.export_explanations(ex.explain(rows), judged(spark, sf_dir)), path)
    schema = "row_id BIGINT, score DOUBLE, label STRING, CommandLine STRING, _label INT, verdict_json STRING"
    saved = ev.read_jsonl(spark, path, schema)
    return saved.select("row_id", F.round("score", 6).alias("score"), "label", F.col("CommandLine").alias("cmd"), "_label", "verdict_json")


# ---- instruction records -----------------------------------------------------------------

CONTEXT_COLUMNS = [
    "EventTime", "Hostname", "Channel", "User", "IntegrityLevel", "SourceImage", "CommandLine", "ParentImage", "ProcessId",
    "_attack_technique",
]
GENERATED = """concat('[', "EventTime", '] | Host=', "Hostname", ' | User=', coalesce("User", 'unknown'), ' | Image=', "SourceImage",
  ' | Parent=', coalesce("ParentImage", 'unknown'), ' | Cmd=', coalesce("CommandLine", 'unknown'))"""
INPUT_TEXT = (
    "concat('{', concat_ws(', ', "
    + ", ".join(
        f"""CASE WHEN trim(coalesce("{c}", '')) <> '' THEN concat('"{c}": ', {js(f'"{c}"')}) END""" for c in CONTEXT_COLUMNS
    )
    + f""", concat('"generated_prompt": ', {js(GENERATED)})), '}}')"""
)
ATTACK = """CASE WHEN trim(coalesce("_attack_technique", '')) <> '' THEN "_attack_technique" END"""
REASON = """CASE WHEN verdict_label IS NOT NULL AND coalesce(verdict_reason, '') <> '' THEN verdict_reason
  ELSE 'Reason not available.' END"""
OUTPUT_TEXT = f"""concat('{{', concat_ws(', ', concat('"label": "', CASE "_label" WHEN 1 THEN 'malicious' ELSE 'benign' END, '"'),
  concat('"explanation": ', {js(REASON)}), CASE WHEN {ATTACK} IS NOT NULL THEN concat('"attack_technique": ', {js(ATTACK)}) END,
  CASE WHEN verdict_label IS NOT NULL AND verdict_confidence IS NOT NULL THEN concat('"confidence": ', {js('verdict_confidence')}) END), '}}')"""


@query("j1_is_valid", f"""SELECT conv_id, turn, text IS NOT NULL AND trim(text) <> '' AS valid FROM conversations""")
def j1_is_valid(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_valid_text(F.col("text")).alias("valid"))


@query("j2_event_context", with_telemetry(f"SELECT row_id, {GENERATED} AS generated_prompt, {INPUT_TEXT} AS input_text FROM telemetry"))
def j2_event_context(spark, sf_dir):
    return cp.event_context(telemetry(spark, sf_dir)).select("row_id", "generated_prompt", "input_text")


@query(
    "j3_output_payload",
    with_judged(
        f"""SELECT row_id, CASE "_label" WHEN 1 THEN 'malicious' ELSE 'benign' END AS label, {REASON} AS explanation,
  {ATTACK} AS attack_technique, CASE WHEN verdict_label IS NOT NULL THEN verdict_confidence END AS confidence,
  {OUTPUT_TEXT} AS output_text FROM judged"""
    ),
)
def j3_output_payload(spark, sf_dir):
    return cp.output_payload(judged(spark, sf_dir)).select("row_id", "output.*", "output_text")


def with_assigned_judged(body: str) -> str:
    return with_telemetry(
        body, ("judged", JUDGED), ("keyed", KEYED), ("stats", STATS), ("groups", GROUPS), ("assigned", ASSIGNED)
    )


@query(
    "j4_instruction_records",
    with_assigned_judged(
        f"""SELECT row_id, split, concat('{pl.DEFAULT_INSTRUCTION}', chr(10), chr(10), 'Context:', chr(10), {INPUT_TEXT}) AS prompt,
  {OUTPUT_TEXT} AS response FROM judged JOIN (SELECT row_id, split FROM assigned) USING (row_id)"""
    ),
)
def j4_instruction_records(spark, sf_dir):
    rows = judged(spark, sf_dir)
    splits = sp.stratified_group_split(add_group_key(rows)).select("row_id", "split")
    records = cp.instruction_records(rows.join(splits, "row_id"), F.col("split"))
    return records.select("row_id", "split", F.col("formatted_prompt").alias("prompt"), F.col("formatted_response").alias("response"))


@query(
    "j5_export_corpus",
    with_assigned_judged(
        f"""SELECT row_id, split, {OUTPUT_TEXT} AS response FROM judged JOIN (SELECT row_id, split FROM assigned) USING (row_id)"""
    ),
)
def j5_export_corpus(spark, sf_dir):
    rows = judged(spark, sf_dir)
    path = scratch_path(spark, "corpus")
    cp.export_corpus(rows, sp.stratified_group_split(add_group_key(rows)), path)
    saved = ev.read_jsonl(spark, path, "row_id BIGINT, formatted_response STRING, split STRING")
    return saved.select("row_id", "split", F.col("formatted_response").alias("response"))


@query(
    "j6_supervised_pairs",
    """SELECT u.conv_id, u.turn, concat(coalesce(s.text, ''), chr(10), chr(10), 'Context:', chr(10), u.text) AS prompt, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system'
WHERE u.role = 'user'""",
)
def j6_supervised_pairs(spark, sf_dir):
    """A system turn is the instruction, a user turn the input, the next assistant turn the output."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input_text"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_text"))
    system = turns.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("instruction"))
    records = user.join(answer, ["conv_id", "turn"]).join(system, "conv_id", "left")
    row = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    pairs = cp.supervised_pairs(records.withColumn("row_id", row))
    parts = F.split("row_id", "/")
    return pairs.select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"), "prompt", "response"
    )


def template_sql(template: str, **values: str) -> str:
    parts = []
    rest = template
    while "<<" in rest:
        before, rest = rest.split("<<", 1)
        name, rest = rest.split(">>", 1)
        parts += ["'" + before.replace("'", "''") + "'", values[name]]
    return f"concat({', '.join(parts)}, '" + rest.replace("'", "''") + "')"


@query(
    "j7_reason_prompt",
    with_impacts(
        "SELECT row_id, "
        + template_sql(
            pl.REASON_PROMPT,
            event=f"""concat('{{"row_id": ', row_id, ', "CommandLine": ', {js('"CommandLine"')}, ', "SourceImage": ', {js('"SourceImage"')}, '}}')""",
            score="printf('%.3f', shown)",
            threshold="'0.500'",
            contributions="coalesce(bullets, 'None')",
            signals=f"CASE WHEN len({signals_sql()}) = 0 THEN 'None' ELSE array_to_string(list_transform(({signals_sql()})[1:3], lambda x: concat('- ', x)), chr(10)) END",
            label="CASE WHEN shown >= 0.5e0 THEN 'MALICIOUS' ELSE 'BENIGN' END",
        )
        + """ AS reason_prompt FROM (SELECT *, round(prob_shape, 6) AS shown FROM stacked)
LEFT JOIN (SELECT row_id, string_agg(concat('- ', phrase, ': impact ', printf('%+.2f', round(impact, 6)), ', value=', rank), chr(10) ORDER BY rank) AS bullets
  FROM top_impacts GROUP BY 1) USING (row_id)"""
    ),
)
def j7_reason_prompt(spark, sf_dir):
    rows = contributed(spark, sf_dir).withColumn("score", F.round("prob_shape", 6))
    numbered = F.transform(
        "contributions",
        lambda c, i: F.struct(
            c["feature"].alias("feature"), c["phrase"].alias("phrase"), (i + 1).cast("string").alias("value"),
            F.round(c["impact"], 6).alias("impact"),
        ),
    )
    explained = ex.explain(rows.withColumn("contributions", numbered))
    return cp.render_reason_prompt(explained).select("row_id", "reason_prompt")


@query(
    "j10_review_prompt",
    with_reviews(
        "SELECT row_id, "
        + template_sql(
            pl.REVIEW_PROMPT,
            event=f"""concat('{{"CommandLine": ', {js('cmd')}, ', "SourceImage": ', {js('image')}, ', "prompt": ', {js('prompt')}, '}}')""",
            verdict="coalesce(verdict_json, '{}')",
            prompt="coalesce(prompt, '')",
            prediction=f"""concat('{{"label": ', {js('label')}, ', "score": ', CAST(score AS VARCHAR), ', "llm_reason": ', {js('llm_reason')},
  ', "note": "LLM reason is explanatory only; classifier is a non-LLM model."}}')""",
            truth="coalesce(CAST(ground_truth AS VARCHAR), 'None')",
        )
        + " AS review_prompt FROM reviews"
    ),
)
def j10_review_prompt(spark, sf_dir):
    inputs = lk.build_review_inputs(review_predictions(spark, sf_dir), judged(spark, sf_dir))
    return cp.render_review_prompt(inputs).select("row_id", "review_prompt")


def answers(spark, sf_dir):
    """Generated texts of many shapes, one per event: around its reason, its properties and its score."""
    t = telemetry(spark, sf_dir)
    n = F.col("row_id") % 7
    reason, props = tx.json_string(F.coalesce("verdict_reason", F.lit(" none "))), F.coalesce("prompt", F.lit("{}"))
    number = F.round("score", 3).cast("string")
    text = (
        F.when(n == 0, F.concat(F.lit('{"label": "MALICIOUS", "explanation": '), reason, F.lit(', "confidence": '), number, F.lit("}")))
        .when(n == 1, F.concat(F.lit('Sure! {"label": "benign", "explanation": '), reason, F.lit("} Anything else?")))
        .when(n == 2, F.concat(F.lit("  Likely benign: "), F.coalesce("verdict_reason", F.lit("event")), F.lit(" \n")))
        .when(n == 3, F.concat(F.lit('{"label": "maybe", "confidence": "high", "event": '), props, F.lit("}")))
        .when(n == 4, F.concat(F.lit('{"label": "malicious"} and '), props))
        .when(n == 5, F.concat(F.lit('```json\n{"label": "'), F.coalesce("verdict_label", F.lit("?")), F.lit('", "explanation": "fenced"}\n```')))
        .otherwise(F.concat(F.lit("} "), F.col("Hostname"), F.lit(" {")))
    )
    return t.select("row_id", F.explode(F.array(text)).alias("text"))


REASON_JSON = js("coalesce(verdict_reason, ' none ')")
ANSWERS = f"""SELECT row_id, CASE row_id % 7
  WHEN 0 THEN concat('{{"label": "MALICIOUS", "explanation": ', {REASON_JSON}, ', "confidence": ', CAST(round(score, 3) AS VARCHAR), '}}')
  WHEN 1 THEN concat('Sure! {{"label": "benign", "explanation": ', {REASON_JSON}, '}} Anything else?')
  WHEN 2 THEN concat('  Likely benign: ', coalesce(verdict_reason, 'event'), ' ', chr(10))
  WHEN 3 THEN concat('{{"label": "maybe", "confidence": "high", "event": ', coalesce(prompt, '{{}}'), '}}')
  WHEN 4 THEN concat('{{"label": "malicious"}} and ', coalesce(prompt, '{{}}'))
  WHEN 5 THEN concat('```json', chr(10), '{{"label": "', coalesce(verdict_label, '?'), '", "explanation": "fenced"}}', chr(10), '```')
  ELSE concat('}} ', "Hostname", ' {{') END AS text FROM telemetry"""
# Parsed by DuckDB: the span from the first to the last brace, if it is one JSON object.
SPANS = r"""SELECT row_id, trim(text, chr(32) || chr(10)) AS cleaned, regexp_extract(text, '\{.*\}', 0, 's') AS span FROM answers"""
OBJECTS = """SELECT row_id, cleaned, CASE WHEN json_valid(span) THEN CASE WHEN json_type(span) = 'OBJECT' THEN span END END AS o FROM spans"""
PARSED = """SELECT row_id, CASE WHEN lower(json_extract_string(o, '$.label')) IN ('malicious', 'benign')
    THEN lower(json_extract_string(o, '$.label')) ELSE 'unknown' END AS label,
  CASE WHEN o IS NULL THEN cleaned ELSE trim(json_extract_string(o, '$.explanation')) END AS explanation,
  json_extract_string(o, '$.confidence') AS confidence, json_type(o, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS is_number
FROM objects"""
ANSWER_PARTS = (("answers", ANSWERS), ("spans", SPANS), ("objects", OBJECTS), ("parsed", PARSED))


@query("j8_parse_model_output", with_telemetry(
    "SELECT row_id, label, explanation, CASE WHEN NOT is_number THEN confidence END AS confidence,"
    " CASE WHEN is_number THEN CAST(confidence AS DOUBLE) END AS number FROM parsed",
    *ANSWER_PARTS,
))
def j8_parse_model_output(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("p", pl.parse_model_output(F.col("text")))
    number = F.when(F.col("p.numeric_confidence"), F.col("p.confidence").cast("double")).alias("number")
    word = F.when(~F.col("p.numeric_confidence"), F.col("p.confidence")).alias("confidence")
    return parsed.select("row_id", "p.label", "p.explanation", word, number)


@query(
    "j9_prediction_to_prob",
    with_telemetry(
        """SELECT row_id, CASE WHEN is_number THEN CAST(confidence AS DOUBLE) WHEN label = 'malicious' THEN 1e0 ELSE 0e0 END AS prob FROM parsed""",
        *ANSWER_PARTS,
    ),
)
def j9_prediction_to_prob(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("p", pl.parse_model_output(F.col("text")))
    prob = lk.prediction_to_prob(F.col("p.label"), F.col("p.confidence"), F.col("p.numeric_confidence"))
    return parsed.select("row_id", prob.alias("prob"))


REVIEW_ANSWERS = f"""SELECT conv_id, turn, CASE turn % 6
  WHEN 0 THEN concat('{{"reason_good": true, "justification": ', {js('text')}, ', "improvements": [', {js('role')}, ', "b"]}}')
  WHEN 1 THEN concat('```json', chr(10), '{{"reason_good": ', conv_id % 3, ', "justification": ', {js('text')}, ', "improvements": []}}', chr(10), '```')
  WHEN 2 THEN concat('{{"reason_good": null, "role": ', {js('role')}, '}}')
  WHEN 3 THEN concat(' ', text, ' ')
  WHEN 4 THEN concat('{{"reason_good": ', {js('role')}, ', "justification": "yes", "improvements": ', {js('role')}, '}}')
  ELSE concat('{{"reason_good": false, "justification": ', {js('text')}, ', "improvements": null}}') END AS answer FROM conversations"""


@query(
    "j11_parse_review_response",
    f"""WITH answers AS ({REVIEW_ANSWERS}),
bodies AS (SELECT *, regexp_replace(regexp_replace(trim(answer, chr(32) || chr(9) || chr(10)), '^```[^\n]*\n', ''), '\n```$', '') AS body FROM answers),
objects AS (SELECT *, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN body END END AS o FROM bodies)
SELECT conv_id, turn, CASE json_type(o, '$.reason_good') WHEN 'BOOLEAN' THEN json_extract_string(o, '$.reason_good') = 'true'
    WHEN 'VARCHAR' THEN json_extract_string(o, '$.reason_good') <> '' WHEN 'NULL' THEN FALSE
    ELSE coalesce(TRY_CAST(json_extract_string(o, '$.reason_good') AS DOUBLE) <> 0, FALSE) END AS reason_good,
  CASE WHEN o IS NULL THEN concat('Could not parse judge response: ', body) ELSE coalesce(json_extract_string(o, '$.justification'), '') END AS justification,
  CASE json_type(o, '$.improvements') WHEN 'ARRAY' THEN array_to_string(json_extract_string(o, '$.improvements[*]'), '|')
    WHEN 'VARCHAR' THEN json_extract_string(o, '$.improvements') ELSE '' END AS improvements FROM objects""",
)
def j11_parse_review_response(spark, sf_dir):
    """Reviews made around the turns of the conversations."""
    turns = table(spark, sf_dir, "conversations")
    n, said, role = F.col("turn") % 6, tx.json_string(F.col("text")), tx.json_string(F.col("role"))
    text = (
        F.when(n == 0, F.concat(F.lit('{"reason_good": true, "justification": '), said, F.lit(', "improvements": ['), role, F.lit(', "b"]}')))
        .when(
            n == 1,
            F.concat(
                F.lit('```json\n{"reason_good": '), (F.col("conv_id") % 3).cast("string"), F.lit(', "justification": '), said,
                F.lit(', "improvements": []}\n```'),
            ),
        )
        .when(n == 2, F.concat(F.lit('{"reason_good": null, "role": '), role, F.lit("}")))
        .when(n == 3, F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
        .when(n == 4, F.concat(F.lit('{"reason_good": '), role, F.lit(', "justification": "yes", "improvements": '), role, F.lit("}")))
        .otherwise(F.concat(F.lit('{"reason_good": false, "justification": '), said, F.lit(', "improvements": null}')))
    )
    # As a generator the text is put together once; the parser reads it in several places.
    reviews = turns.select("conv_id", "turn", F.explode(F.array(text)).alias("answer"))
    parsed = reviews.select("conv_id", "turn", pl.parse_review_response(F.col("answer")).alias("p"))
    return parsed.select("conv_id", "turn", "p.reason_good", "p.justification", F.array_join("p.improvements", "|").alias("improvements"))


@query(
    "j12_default_reason",
    with_telemetry(
        """SELECT row_id, CASE WHEN coalesce(verdict_reason, '') = '' THEN 'No explanation generated.' ELSE verdict_reason END AS reason
FROM telemetry"""
    ),
)
def j12_default_reason(spark, sf_dir):
    return telemetry(spark, sf_dir).select("row_id", pl.reason_or_default(F.col("verdict_reason")).alias("reason"))


# ---- costs -------------------------------------------------------------------------------

PUBLIC_NAMES = {"value": "gbdt", "keyword": "Text", "shape": "st"}


def scored_public(spark, sf_dir):
    """The scored telemetry under the names that the price tables know."""
    names = F.create_map(*[F.lit(x) for pair in PUBLIC_NAMES.items() for x in pair])
    return score_runs(spark, sf_dir).withColumn("model", names[F.col("model")])


PUBLIC = """SELECT CASE model WHEN 'value' THEN 'gbdt' WHEN 'keyword' THEN 'Text' ELSE 'st' END AS model, row_id, "_label", score
FROM scored"""


def latencies(spark, sf_dir, scores=None):
    """Stand-in latencies that depend on the whole scored table: the mean score in milliseconds."""
    scores = scored_public(spark, sf_dir) if scores is None else scores
    own = scores.groupBy("model").agg(F.round(F.avg("score") / 1000, 9).alias("latency_seconds"))
    base = telemetry(spark, sf_dir).agg(F.round(F.avg("score"), 6).alias("latency_seconds")).select(F.lit("claude").alias("model"), "latency_seconds")
    return own.unionByName(base)


LATENCIES = """SELECT model, round(avg(score) / 1000, 9) AS latency_seconds FROM public GROUP BY 1
UNION ALL SELECT 'claude', round(avg(score), 6) FROM telemetry"""
PRICED = """SELECT l.model, coalesce(r.resource, 'cpu_small') AS resource, l.latency_seconds FROM latencies l LEFT JOIN
  (VALUES ('gbdt', 'cpu_small'), ('text', 'cpu_small'), ('st', 'gpu_small'), ('claude', 'api')) r(m, resource) ON lower(l.model) = r.m"""
COSTS = """SELECT lower(model) AS model, latency_seconds, CASE WHEN resource = 'api' THEN 0.0018e0 WHEN latency_seconds > 0
    THEN hourly / ((3600e0 / latency_seconds) * 0.7e0) END AS per_prediction_usd,
  CASE WHEN resource = 'api' THEN description ELSE concat(description, ' @ util=0.7') END AS notes FROM priced JOIN
  (VALUES ('cpu_small', 0.096e0, 'AWS m5.large on-demand (2 vCPU)'), ('gpu_small', 1.006e0, 'AWS g5.2xlarge on-demand (1xL4)'),
    ('api', NULL, 'Claude Sonnet 4.5 (assignment brief)')) p(resource, hourly, description) USING (resource)"""


def with_costs(body: str, *extra: tuple[str, str]) -> str:
    return with_scored(body, ("public", PUBLIC), ("latencies", LATENCIES), ("priced", PRICED), ("costs", COSTS), *extra)


@query(
    "a8_parameter_map",
    """SELECT event_type AS model, round(avg(value), 6) AS per_prediction_usd, count(*) AS n_rows FROM events GROUP BY 1""",
)
def a8_parameter_map(spark, sf_dir):
    """A JSON object keyed by upper-cased model, written from the events and read back by lower-cased key."""
    path = scratch_path(spark, "parameters")
    per_type = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("per_prediction_usd"), F.count("*").alias("n_rows")
    )
    entry = F.struct(F.upper("event_type"), F.struct("per_prediction_usd", "n_rows"))
    whole = per_type.agg(F.to_json(F.map_from_entries(F.collect_list(entry)), {"pretty": "true"}).alias("value"))
    whole.write.text(path)
    return ev.read_parameter_map(spark, path, "per_prediction_usd: DOUBLE, n_rows: BIGINT")


@query("d10_resource_prices", with_costs("SELECT model, resource, latency_seconds FROM priced"))
def d10_resource_prices(spark, sf_dir):
    return co.with_prices(latencies(spark, sf_dir)).select("model", "resource", "latency_seconds")


@query(
    "k1_latency_stats",
    """SELECT model, round(avg(seconds), 6) AS total_seconds, round(avg(seconds / n_rows), 6) AS per_row_seconds, count(*) AS runs FROM (
  SELECT event_type AS model, user_id, count(*) AS n_rows, sum(value) / 1000e0 AS seconds FROM events GROUP BY ALL) GROUP BY 1""",
)
def k1_latency_stats(spark, sf_dir):
    """One run per user and event type, with the summed value as its duration."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), "user_id").agg(
        F.count("*").alias("n_rows"), (F.sum("value") / 1000.0).alias("seconds")
    )
    return rounded(md.latency_stats(runs), ["total_seconds", "per_row_seconds"])


@query(
    "k2_cost_per_prediction",
    with_costs("SELECT model, round(per_prediction_usd, 12) AS per_prediction_usd, latency_seconds, concat('old | ', notes) AS notes FROM costs"),
)
def k2_cost_per_prediction(spark, sf_dir):
    rows = latencies(spark, sf_dir)
    old = rows.select(F.lower("model").alias("model"), F.lit(0.5).alias("per_prediction_usd"), F.lit("old").alias("notes"))
    costs = co.cost_per_prediction(rows, old)
    return costs.withColumn("per_prediction_usd", F.round("per_prediction_usd", 12))


@query(
    "d9_cost_lookup",
    with_costs(
        """SELECT m.model, round(coalesce(c.per_prediction_usd, 0e0), 12) AS per_prediction_usd
FROM (SELECT DISTINCT model FROM public UNION ALL SELECT 'unpriced') m LEFT JOIN costs c ON lower(m.model) = c.model"""
    ),
)
def d9_cost_lookup(spark, sf_dir):
    rows = latencies(spark, sf_dir)
    models = rows.select(F.when(F.col("model") == "claude", "unpriced").otherwise(F.col("model")).alias("model"))
    return co.attach_costs(models, co.cost_per_prediction(rows)).withColumn("per_prediction_usd", F.round("per_prediction_usd", 12))


METRIC = """SELECT r.model, accuracy, precision_1, recall_1, f1_1, a.roc_auc, a.average_precision, r.n,
  macro_precision, macro_recall, macro_f1, weighted_precision, weighted_recall, weighted_f1
FROM report r JOIN (SELECT model, sum(CAST(n AS DOUBLE) * (tp - p + p / 2e0)) / (any_value(pt) * CAST(any_value(nt) AS DOUBLE)) AS roc_auc,
  sum(CAST(p AS DOUBLE) / pt * tp / (tp + fp)) AS average_precision FROM curve GROUP BY model) a USING (model)"""
BENCH = """SELECT model, recall_1, round(latency_seconds, 6) AS latency_seconds, round(per_million, 6) AS per_million_usd,
  round(CASE WHEN bl <> 0 AND latency_seconds <> 0 THEN bl / latency_seconds END, 6) AS speedup,
  round(CASE WHEN bc <> 0 AND cost <> 0 THEN bc / cost END, 6) AS savings, ordinal FROM (
  SELECT m.model, m.recall_1, l.latency_seconds, coalesce(c.per_prediction_usd, 0e0) AS cost,
    coalesce(c.per_prediction_usd, 0e0) * 1000000 AS per_million,
    CASE m.model WHEN 'gbdt' THEN 0 WHEN 'Text' THEN 1 ELSE 2 END AS ordinal
  FROM metric m JOIN latencies l USING (model) LEFT JOIN costs c ON lower(m.model) = c.model),
  (SELECT per_prediction_usd AS bc, latency_seconds AS bl FROM costs WHERE model = 'claude')"""
METRIC_PARTS = (
    ("confusion", CONFUSION.replace("FROM scored", "FROM public")),
    ("report", REPORT),
    ("curve", CURVE.replace("FROM scored", "FROM public")),
    ("metric", METRIC),
    ("bench", BENCH),
)


def model_metrics(spark, sf_dir, scores):
    """Metrics per model with latency and the listing order."""
    position = F.create_map(F.lit("gbdt"), F.lit(0), F.lit("Text"), F.lit(1), F.lit("st"), F.lit(2))
    lat = latencies(spark, sf_dir, scores).withColumnRenamed("latency_seconds", "per_row_seconds")
    table_, _ = md.compare_models(scores, latency=lat)
    return table_.withColumn("ordinal", position[F.col("model")])


def benchmark(spark, sf_dir, scores=None):
    scores = scored_public(spark, sf_dir) if scores is None else scores
    verdict = m.verdict_metrics(telemetry(spark, sf_dir), "verdict_label")
    metrics = model_metrics(spark, sf_dir, scores)
    return co.cost_benchmark(metrics, co.cost_per_prediction(latencies(spark, sf_dir, scores)), verdict)


@query(
    "k3_cost_benchmark",
    with_costs(
        """SELECT * EXCLUDE (recall_1), round(recall_1, 6) AS recall_1 FROM bench UNION ALL BY NAME
SELECT 'claude' AS model, round(latency_seconds, 6) AS latency_seconds, round(per_prediction_usd * 1000000, 6) AS per_million_usd,
  1e0 AS speedup, 1e0 AS savings, -1 AS ordinal, (SELECT round(count(*) FILTER (WHERE lower(verdict_label) = 'malicious' AND "_label" = 1)
    / CAST(count(*) FILTER (WHERE "_label" = 1) AS DOUBLE), 6) FROM telemetry) AS recall_1 FROM costs WHERE model = 'claude'""",
        *METRIC_PARTS,
    ),
)
def k3_cost_benchmark(spark, sf_dir):
    columns = ["recall_1", "latency_seconds", "per_million_usd", "speedup", "savings"]
    rows = rounded(benchmark(spark, sf_dir), columns)
    return rows.select("model", "ordinal", *columns)


@query(
    "e19_leaders",
    with_costs(
        """SELECT (SELECT model FROM bench ORDER BY recall_1 DESC, ordinal LIMIT 1) AS best_recall,
  (SELECT model FROM bench ORDER BY coalesce(speedup, 0) DESC, ordinal LIMIT 1) AS fastest,
  (SELECT model FROM bench ORDER BY coalesce(savings, 0) DESC, ordinal LIMIT 1) AS cheapest""",
        *METRIC_PARTS,
    ),
)
def e19_leaders(spark, sf_dir):
    return co.leaders(benchmark(spark, sf_dir))


HEADLINE = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]


@query(
    "k4_dashboard_table",
    with_costs(
        f"""SELECT model, {rounded_sql(['accuracy', 'roc_auc', 'average_precision'])}, round(precision_1, 6) AS "precision",
  round(recall_1, 6) AS recall, round(f1_1, 6) AS f1, round(latency_seconds * 1000, 6) AS latency_ms
FROM metric JOIN latencies USING (model)""",
        *METRIC_PARTS,
    ),
)
def k4_dashboard_table(spark, sf_dir):
    metrics = model_metrics(spark, sf_dir, scored_public(spark, sf_dir))
    return rounded(co.dashboard_table(metrics), [*HEADLINE, "latency_ms"])


AVERAGES = [f"{a}_{x}" for a in ("macro", "weighted") for x in ("precision", "recall", "f1")]


@query(
    "k5_dashboard_details",
    with_costs(
        f"""SELECT model, n, {rounded_sql(AVERAGES)}, target, threshold, tp, fp, tn, fn, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, per_million_usd, speedup, savings FROM metric
JOIN (SELECT model, target, threshold, tp, fp, tn, fn, "precision", recall FROM (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY abs(threshold - target), threshold) AS r
  FROM points, (SELECT i / 10e0 AS target FROM range(1, 10) t(i))) WHERE r = 1) USING (model)
JOIN (SELECT model, per_million_usd, speedup, savings FROM bench) USING (model)""",
        *METRIC_PARTS,
        ("points", sweep_sql(GRID).replace("FROM scored,", "FROM public,")),
    ),
)
def k5_dashboard_details(spark, sf_dir):
    scores = scored_public(spark, sf_dir)
    metrics = model_metrics(spark, sf_dir, scores)
    points = m.threshold_sweep(scores, by=["model"])
    sampled = m.nearest_threshold_rows(points, [round(i / 10, 1) for i in range(1, 10)], ["model"])
    details = co.dashboard_details(metrics, sampled, benchmark(spark, sf_dir, scores))
    money = ["per_million_usd", "speedup", "savings"]
    flat = details.select("model", "n", *AVERAGES, *money, F.inline("threshold_rows"))
    rows = rounded(flat, [*AVERAGES, *money, "precision", "recall"])
    return rows.select("model", "n", *AVERAGES, "target", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", *money)

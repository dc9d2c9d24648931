"""Registered queries: ingest, validation, identity and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.catalog.registry import query
from cmdprism.catalog.telemetry import (
    FEATURE_LIST_SQL,
    feature_sql,
    group_key_sql,
    normalized_sql,
    table,
    telemetry,
    with_features,
    with_telemetry,
)
from cmdprism.functions import labels as lb
from cmdprism.functions import text as tx
from cmdprism.functions.features import FEATURES, align_features, build_features
from cmdprism.functions.text import WHITESPACE
from cmdprism.operators import ingest
from cmdprism.session import scratch_path
from cmdprism.sources import events as ev
from cmdprism.sources import tables as tb


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as commands: the longest and most varied texts supplied."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("CommandLine"), F.col("source").alias("SourceImage"), F.col("lang").alias("prompt")
    )


def raw_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as JSON lines, some broken on purpose, in ``row_id`` order."""
    t = telemetry(spark, sf_dir)
    rid = F.col("row_id")
    label = (
        F.when(rid % 5 == 0, F.to_json(F.struct(F.col("verdict_label").alias("v"))))
        .when(rid % 5 == 1, F.lit('{"v":true}'))
        .when(rid % 5 == 2, F.lit('{"v":1.0}'))
        .when(rid % 5 == 3, F.lit('{"v":" benign "}'))
        .otherwise(F.lit('{"v":"0"}'))
    )
    flat = F.regexp_extract(label, r'^\{"v":(.*)\}\z', 1)
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit('"ProcessId": '), tx.json_string(F.col("ProcessId"))),
        F.when(F.col("CommandLine").isNotNull(), F.concat(F.lit('"CommandLine": '), tx.json_string(F.col("CommandLine")))),
        F.concat(F.lit('"SourceImage": '), tx.json_string(F.col("SourceImage"))),
        F.concat(F.lit('"prompt": '), F.when(rid % 13 == 0, rid.cast("string")).otherwise(tx.json_string(F.col("prompt")))),
        F.when(flat != "", F.concat(F.lit(f'"{ev.VERDICT_FIELD}.predicted_label": '), flat)),
        F.when(
            F.col("verdict_label").isNotNull() | (rid % 7 == 0),
            F.concat(
                F.lit(f'"{ev.VERDICT_FIELD}": {{"predicted_label": '),
                tx.json_string(F.coalesce(F.col("verdict_label"), F.lit("benign"))),
                F.lit("}"),
            ),
        ),
    )
    line = F.concat(F.lit("{"), parts, F.lit("}"))
    line = (
        F.when(rid % 11 == 0, F.concat(F.lit("{"), line))
        .when(rid % 11 == 1, F.concat(line, F.lit(" trailing")))
        .when(rid % 11 == 2, F.concat(F.lit("["), line, F.lit("]")))
        .when(rid % 11 == 3, F.concat(F.lit("\t "), line, F.lit("\n   ")))
        .otherwise(line)
    )
    return t.select("row_id", line.alias("line")).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")


def written_events(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw-events")
    raw_event_lines(spark, sf_dir).select("line").write.text(path)
    return path


LABEL_TEXT = """CASE row_id % 5 WHEN 0 THEN verdict_label WHEN 1 THEN 'true' WHEN 2 THEN '1' WHEN 3 THEN ' benign ' ELSE '0' END"""


@query(
    "a1_read_events",
    with_telemetry(
        f"""SELECT 'event' AS outcome, "ProcessId" AS process_id, "CommandLine" AS command, "SourceImage" AS image,
  CASE WHEN row_id % 13 = 0 THEN CAST(row_id AS VARCHAR) ELSE prompt END AS prompt, row_id % 13 = 0 AS bad_prompt, {LABEL_TEXT} AS flat_label,
  coalesce(verdict_label, CASE WHEN row_id % 7 = 0 THEN 'benign' END) AS nested_label, NULL AS raw_length
FROM telemetry WHERE row_id % 11 NOT IN (0, 1, 2)
UNION ALL SELECT 'quarantined', NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM telemetry WHERE row_id % 11 IN (0, 1, 2) GROUP BY row_id"""
    ),
)
def a1_read_events(spark, sf_dir):
    """Every event with the fields that were written, and a row for each rejected line."""
    good, bad = ev.read_events(spark, written_events(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    events = good.select(
        F.lit("event").alias("outcome"), F.col("ProcessId").alias("process_id"), F.col("CommandLine").alias("command"),
        F.col("SourceImage").alias("image"), "prompt", F.array_contains("bad_fields", "prompt").alias("bad_prompt"),
        F.expr("try_variant_get(flat_label, '$', 'string')").alias("flat_label"),
        F.expr("try_variant_get(verdict.predicted_label, '$', 'string')").alias("nested_label"),
        F.lit(None).cast("bigint").alias("raw_length"),
    )
    names = ["process_id", "command", "image", "prompt", "flat_label", "nested_label"]
    rejected = bad.select(
        F.lit("quarantined").alias("outcome"), *[nothing.alias(n) for n in names], F.lit(None).cast("boolean").alias("bad_prompt"),
        (F.length("raw") > 0).cast("bigint").alias("raw_length"),
    )
    return events.unionByName(rejected)


@query(
    "a1_line_numbers",
    with_telemetry(
        """SELECT CAST(row_id AS VARCHAR) AS process_id, line_number FROM (
  SELECT row_id, CAST(1 + coalesce(sum(CASE WHEN row_id % 11 = 3 THEN 2 ELSE 1 END) OVER (
    PARTITION BY row_id % 4 ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_number FROM telemetry)
WHERE row_id % 11 IN (0, 1, 2)"""
    ),
)
def a1_line_numbers(spark, sf_dir):
    """Where each rejected line stands in its file; every eleventh event is followed by a blank line."""
    path = scratch_path(spark, "raw-events")
    lines = raw_event_lines(spark, sf_dir).withColumn("file", F.col("row_id") % 4)
    lines.repartition(4, "file").sortWithinPartitions("file", "row_id").select("line", "file").write.partitionBy("file").text(path)
    _, bad = ev.read_events(spark, path)
    return bad.select(F.regexp_extract("raw", '"ProcessId": "([0-9]+)"', 1).alias("process_id"), "line_number")


@query(
    "a2_row_id",
    with_telemetry(
        """SELECT "ProcessId" AS process_id, row_number() OVER (ORDER BY row_id) - 1 AS row_id
FROM telemetry WHERE row_id % 11 NOT IN (0, 1, 2)"""
    ),
)
def a2_row_id(spark, sf_dir):
    good, _ = ev.read_events(spark, written_events(spark, sf_dir))
    return ev.with_file_row_id(good).select(F.col("ProcessId").alias("process_id"), "row_id")


@query(
    "a2_row_id_by_key",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders",
)
def a2_row_id_by_key(spark, sf_dir):
    return ingest.with_row_id(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def row_hash_sql(key: str, source: str) -> str:
    def js(c):
        body = f"replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
        for code, mark in ((9, "t"), (10, "n"), (13, "r")):
            body = f"replace({body}, chr({code}), chr(92) || '{mark}')"
        return f"coalesce('\"' || {body} || '\"', 'null')"

    return f"""SELECT {key} AS id, sha256(concat('{{"CommandLine": ', {js('"CommandLine"')},
  ', "SourceImage": ', {js('"SourceImage"')}, ', "prompt": ', {js('prompt')}, '}}')) AS row_hash FROM {source}"""


DOCUMENTS_SQL = '(SELECT doc_id, text AS "CommandLine", source AS "SourceImage", lang AS prompt FROM documents)'


@query("a3_row_hash", with_telemetry(row_hash_sql("row_id", "telemetry")))
def a3_row_hash(spark, sf_dir):
    return ingest.with_row_hash(telemetry(spark, sf_dir)).select(F.col("row_id").alias("id"), "row_hash")


@query("a3_row_hash_documents", row_hash_sql("doc_id", DOCUMENTS_SQL))
def a3_row_hash_documents(spark, sf_dir):
    return ingest.with_row_hash(documents(spark, sf_dir)).select(F.col("doc_id").alias("id"), "row_hash")


@query(
    "a4_processed_round_trip",
    with_telemetry(
        f"""SELECT row_id, {group_key_sql('"SourceImage"', '"CommandLine"')} AS group_key, "_label" FROM telemetry"""
    ),
)
def a4_processed_round_trip(spark, sf_dir):
    path = scratch_path(spark, "processed")
    tb.write_processed(ingest.add_group_key(telemetry(spark, sf_dir)), path)
    return tb.read_processed(spark, path).select("row_id", "group_key", "_label")


@query(
    "a6_a7_jsonl_round_trip",
    with_telemetry('SELECT row_id, "CommandLine", "SourceImage", prompt, round(score, 6) AS score FROM telemetry'),
)
def a6_a7_jsonl_round_trip(spark, sf_dir):
    path = scratch_path(spark, "records")
    ev.write_jsonl(telemetry(spark, sf_dir).select("row_id", "CommandLine", "SourceImage", "prompt", "score"), path)
    schema = "row_id BIGINT, CommandLine STRING, SourceImage STRING, prompt STRING, score DOUBLE"
    records = ev.require_rows(ev.read_jsonl(spark, path, schema), "records")
    return records.withColumn("score", F.round("score", 6))


@query(
    "a9_json_folder",
    """SELECT source AS "key", lang, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) AS n_docs
FROM documents GROUP BY ALL""",
)
def a9_json_folder(spark, sf_dir):
    """One multi-line file per source, written from the table, then read back as one row per file."""
    path = scratch_path(spark, "folder")
    docs = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_docs")
    )
    per_source = docs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("lang", "n_chars", "n_docs"))).alias("langs"))
    body = F.to_json(F.struct("source", "langs"), {"pretty": "true"})
    per_source.select("source", body.alias("value")).repartition("source").write.partitionBy("source").text(path)
    schema = "source STRING, langs ARRAY<STRUCT<lang: STRING, n_chars: BIGINT, n_docs: BIGINT>>"
    files = ev.read_json_folder(spark, path, schema, glob="*.txt")
    return files.select(F.col("source").alias("key"), F.inline("langs")).select("key", "lang", "n_chars", "n_docs")


@query(
    "b1_normalize_label",
    with_telemetry(
        """SELECT word, code, count(*) AS n_rows FROM (
  SELECT word, CASE lower(word) WHEN 'benign' THEN 0 WHEN 'malicious' THEN 1 WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '01' THEN 1 END AS code
  FROM (SELECT CASE row_id % 8 WHEN 0 THEN verdict_label WHEN 1 THEN ' benign ' WHEN 2 THEN '1' WHEN 3 THEN '2'
    WHEN 4 THEN 'Benign' WHEN 5 THEN '01' WHEN 6 THEN 'true' ELSE '0' END AS word FROM telemetry))
GROUP BY ALL"""
    ),
)
def b1_normalize_label(spark, sf_dir):
    n = F.col("row_id") % 8
    word = F.when(n == 0, F.col("verdict_label"))
    for i, text in enumerate([" benign ", "1", "2", "Benign", "01", "true", "0"], start=1):
        word = word.when(n == i, text)
    rows = telemetry(spark, sf_dir).select(word.alias("word")).withColumn("code", lb.label_from_text(F.col("word")))
    return rows.groupBy("word", "code").agg(F.count("*").alias("n_rows"))


RESOLVED_SQL = """SELECT row_id, "ProcessId", row_id % 13 = 0 AS bad_prompt,
  CASE WHEN row_id % 5 = 0 THEN coalesce(verdict_label, CASE WHEN row_id % 7 = 0 THEN 'benign' END)
    WHEN row_id % 5 = 1 THEN '1' WHEN row_id % 5 = 2 THEN '1' WHEN row_id % 5 = 3 THEN ' benign ' ELSE '0' END AS word
  FROM telemetry WHERE row_id % 11 NOT IN (0, 1, 2)"""
CODE_SQL = "CASE lower(word) WHEN 'benign' THEN 0 WHEN 'malicious' THEN 1 WHEN '0' THEN 0 WHEN '1' THEN 1 END"


@query(
    "b2_resolve_label",
    with_telemetry(f'SELECT "ProcessId" AS process_id, {CODE_SQL} AS label FROM ({RESOLVED_SQL})'),
)
def b2_resolve_label(spark, sf_dir):
    good, _ = ev.read_events(spark, written_events(spark, sf_dir))
    rows = ingest.resolve_label(good).withColumn("label", lb.label_from_variant("_resolved"))
    return rows.select(F.col("ProcessId").alias("process_id"), "label")


@query(
    "b3_validate_events",
    with_telemetry(
        f"""SELECT "ProcessId" AS process_id, CASE WHEN word IS NULL THEN 'missing_label' WHEN {CODE_SQL} IS NULL THEN 'invalid_label'
  WHEN bad_prompt THEN 'non_text_field' ELSE 'valid' END AS outcome, {CODE_SQL} AS label FROM ({RESOLVED_SQL})"""
    ),
)
def b3_validate_events(spark, sf_dir):
    good, _ = ev.read_events(spark, written_events(spark, sf_dir))
    valid, rejected = ingest.validate_events(good)
    kept = valid.select(F.col("ProcessId").alias("process_id"), F.lit("valid").alias("outcome"), F.col("_label").alias("label"))
    return kept.unionByName(rejected.select(F.col("ProcessId").alias("process_id"), F.col("reject_reason").alias("outcome"), F.col("_label").alias("label")))


@query(
    "b3_reject_counts",
    with_telemetry(
        f"""SELECT CASE WHEN word IS NULL THEN 'missing_label' WHEN {CODE_SQL} IS NULL THEN 'invalid_label'
  WHEN bad_prompt THEN 'non_text_field' ELSE 'valid' END AS outcome, count(*) AS n_rows
FROM ({RESOLVED_SQL}) GROUP BY ALL"""
    ),
)
def b3_reject_counts(spark, sf_dir):
    good, _ = ev.read_events(spark, written_events(spark, sf_dir))
    return ingest.reject_counts(ingest.check_events(good))


@query(
    "b4_normalize_commandline",
    f"SELECT doc_id, {normalized_sql('text')} AS normalized FROM documents",
)
def b4_normalize_commandline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_commandline(F.col("text")).alias("normalized"))


@query(
    "b5_basename",
    r"""SELECT page_id, CASE WHEN b = '.' THEN '' ELSE lower(b) END AS base FROM (
  SELECT page_id, list_extract(list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.'), -1) AS b FROM pages)""",
)
def b5_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.basename(F.col("url")).alias("base"))


@query(
    "b6_group_key",
    with_telemetry(f"""SELECT row_id, {group_key_sql('"SourceImage"', '"CommandLine"')} AS group_key FROM telemetry"""),
)
def b6_group_key(spark, sf_dir):
    return ingest.add_group_key(telemetry(spark, sf_dir)).select("row_id", "group_key")


@query(
    "b7_clean_command_text",
    f"""SELECT doc_id, lower(trim(regexp_replace(text, '[{WHITESPACE}]+', ' ', 'g'))) AS cleaned FROM documents""",
)
def b7_clean_command_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_command_text(F.col("text")).alias("cleaned"))


@query(
    "b8_require_labeled",
    "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
)
def b8_require_labeled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ingest.require_labeled(docs, "quality").select("doc_id", "quality")


@query(
    "b9_sample_rows",
    with_telemetry('SELECT row_id, "_label" FROM telemetry ORDER BY row_id LIMIT 20'),
)
def b9_sample_rows(spark, sf_dir):
    return ingest.sample_rows(telemetry(spark, sf_dir).select("row_id", "_label"), 20)


@query(
    "b10_display_columns",
    with_telemetry(
        """SELECT row_id, substr(coalesce("CommandLine", ''), 1, 120) AS command_short,
  substr("SourceImage", 1, 40) AS image_short, printf('%.3f', score) AS score_short FROM telemetry"""
    ),
)
def b10_display_columns(spark, sf_dir):
    shown = ingest.display_columns(telemetry(spark, sf_dir))
    return shown.select("row_id", "command_short", "image_short", "score_short")


def rounded_features(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *FEATURES).withColumn("cmd_upper_ratio", F.round("cmd_upper_ratio", 6))


@query("c26_features", with_features(f"SELECT row_id, {FEATURE_LIST_SQL} FROM features"))
def c26_features(spark, sf_dir):
    return rounded_features(build_features(telemetry(spark, sf_dir)), "row_id")


@query(
    "c26_features_documents",
    f"""SELECT doc_id, {FEATURE_LIST_SQL} FROM (
{feature_sql("documents", "text", "source", "doc_id")})""",
)
def c26_features_documents(spark, sf_dir):
    return rounded_features(build_features(documents(spark, sf_dir)), "doc_id")


@query(
    "c28_align_features",
    with_features(
        """SELECT row_id, CAST(cmd_length AS DOUBLE) AS cmd_length, source_image_base, cmd_exe_base,
  0e0 AS custom_numeric, 'unknown' AS custom_category, CAST(TRY_CAST("ProcessId" AS DOUBLE) AS DOUBLE) AS "ProcessId",
  0e0 AS "Hostname" FROM features"""
    ),
)
def c28_align_features(spark, sf_dir):
    wanted = ["cmd_length", "source_image_base", "cmd_exe_base", "custom_numeric", "custom_category", "ProcessId", "Hostname"]
    categoricals = ["source_image_base", "cmd_exe_base", "custom_category"]
    return align_features(build_features(telemetry(spark, sf_dir)), wanted, categoricals, keep=["row_id"])

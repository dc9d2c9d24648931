"""JSON-Lines telemetry: scan with quarantine, dense row ids, JSON-Lines and folder readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cmdprism.functions.text import parse_object, strip
from cmdprism.plans.prefix import running_totals
from cmdprism.session import ROW_ID
from cmdprism.sources.tables import materialize

# Names of the declared event fields; every one is read as text.
EVENT_FIELDS = [
    "EventID", "EventTime", "UtcTime", "Hostname", "Channel", "ProcessId", "ProcessGUID",
    "ParentProcessId", "ParentProcessGUID", "User", "Domain", "AccountName", "IntegrityLevel",
    "LogonId", "Image", "ParentImage", "ParentCommandLine", "CurrentDirectory", "TargetFilename",
    "CreationUtcTime", "TargetObject", "EventType", "SourcePort", "DestinationIp", "DestinationPort",
    "DestinationHostname", "Protocol", "_source", "_attack_technique",
]
TEXT_FIELDS = ["CommandLine", "SourceImage", "prompt"]
# Fixed value: the key that holds the reviewer's verdict; the flat copy adds ".predicted_label".
VERDICT_FIELD = "claude-sonnet-4-5"
VERDICT_SCHEMA = (
    "STRUCT<predicted_label: VARIANT, reason: STRING, confidence: STRING, "
    "attack_technique: STRING, technique: STRING>"
)


def event_schema(verdict_field: str = VERDICT_FIELD) -> str:
    fields = [f"`{name}` STRING" for name in EVENT_FIELDS]
    fields += [f"`{name}` VARIANT" for name in TEXT_FIELDS]
    fields += [f"`{verdict_field}` STRING", f"`{verdict_field}.predicted_label` VARIANT"]
    return ", ".join(f.replace("` ", "`: ", 1) for f in fields)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines, blank ones included, with the file block they come from."""
    value = F.col("value")
    bare = value.startswith("{") & value.endswith("}")
    return spark.read.text(path).select(
        F.when(bare, value).otherwise(strip(value)).alias("raw"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
    )


def with_line_number(table: DataFrame) -> DataFrame:
    """Add the 1-based ``line_number`` of each row within its file. ``table`` is written and holds every line of the files.

    A piece (one file block in one part of the table) is read in order by one task; a window over a file's pieces gives their offsets.
    """
    piece = ["file_path", "file_block", "part", "part_block"]
    numbered = table.withColumn("_seq", F.monotonically_increasing_id())
    pieces = numbered.groupBy(*piece).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("file_path").orderBy(*piece[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*piece, (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return numbered.join(offsets, piece).withColumn("line_number", F.col("_seq") + F.col("_shift")).drop("_seq", "_shift")


def read_events(spark: SparkSession, path: str, verdict_field: str = VERDICT_FIELD) -> tuple[DataFrame, DataFrame]:
    """Scan JSON Lines into events and a quarantine of lines that are no JSON object.

    Lines are parsed once, into one table in the shared folder; both results are parts of it. ``part`` and
    ``part_block`` say where a row stands in that table. Rejected lines carry their ``line_number``, for which blank lines count too.
    """
    lines = read_lines(spark, path)
    event = parse_object(F.col("raw"), event_schema(verdict_field))
    # As a generator the parser runs once per line; a plain column would be computed again for each field.
    parsed = lines.select("*", F.explode(F.array(event)).alias("_event"))
    bad_fields = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.expr(f"schema_of_variant(_event.`{n}`)").isin("STRING", "VOID"), F.lit(True)), n)
                for n in TEXT_FIELDS
            ]
        )
    )
    rows = parsed.select(
        F.col("_event").isNotNull().alias("is_event"),
        "raw",
        "file_path",
        "file_block",
        *[F.col(f"_event.`{n}`").alias(n) for n in EVENT_FIELDS],
        *[F.expr(f"try_variant_get(_event.`{n}`, '$', 'string')").alias(n) for n in TEXT_FIELDS],
        F.from_json(F.col(f"_event.`{verdict_field}`"), VERDICT_SCHEMA).alias("verdict"),
        F.col(f"_event.`{verdict_field}.predicted_label`").alias("flat_label"),
        bad_fields.alias("bad_fields"),
    ).withColumn("EventID", F.col("EventID").try_cast("int"))
    table = materialize(rows, "events").select(
        "*", F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("part_block")
    )
    good = table.where("is_event").drop("is_event")
    rejected = with_line_number(table).where("NOT is_event AND raw <> ''")
    return good, rejected.select("raw", "file_path", "file_block", "line_number")


def with_file_row_id(events: DataFrame) -> DataFrame:
    """Dense 0-based ``row_id`` in file order over the events of a scan.

    A piece (the rows of one file block in one part of the written table) is read in order by one task. One pass counts the rows of
    each piece; the second adds the piece's offset to the position within it, so no row has to move.
    """
    piece = ["file_path", "file_block", "part", "part_block"]
    numbered = events.withColumn("_seq", F.monotonically_increasing_id())
    pieces = numbered.groupBy(*piece).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    ordered = running_totals(pieces.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in piece], ["_n"])
    offsets = materialize(ordered.select(*piece, (F.col("_n_before") - F.col("_first")).alias("_shift")), "pieces")
    return numbered.join(offsets, piece).withColumn(ROW_ID, F.col("_seq") + F.col("_shift")).drop("_seq", "_shift", "part", "part_block")


def write_jsonl(df: DataFrame, path: str, keep_null: bool = False) -> None:
    """One JSON object per line; non-ASCII text is kept as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_null).lower()).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a known schema: blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def read_json_folder(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One object per multi-line file, with the file's stem as ``key``; malformed files are skipped."""
    raw = (
        spark.read.schema(f"{schema}, _corrupt STRING")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(path)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", "")
    return raw.select(stem.alias("key"), "*").where(F.col("_corrupt").isNull()).drop("_corrupt")


def read_parameter_map(spark: SparkSession, path: str, value_schema: str, key: str = "model") -> DataFrame:
    """A JSON object keyed by model as one row per model, keys lower-cased."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{value_schema}>>")).alias(key, "_v"))
    return parsed.select(F.lower(key).alias(key), "_v.*")

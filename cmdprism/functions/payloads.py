"""Texts for instruction records, reasons and reviews, and parsers for what comes back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdprism.functions.numbers import fixed, float_text
from cmdprism.functions.text import is_valid_text, json_string, or_unknown, parse_object, strip

# Event fields of an instruction record, in output order.
CONTEXT_FIELDS = [
    "EventTime", "Hostname", "Channel", "User", "Domain", "AccountName", "IntegrityLevel", "SourceImage", "Image",
    "CommandLine", "ParentImage", "ParentCommandLine", "ProcessId", "ParentProcessId", "ProcessGUID",
    "ParentProcessGUID", "CurrentDirectory", "LogonId", "SourcePort", "DestinationIp", "DestinationPort",
    "DestinationHostname", "Protocol", "_attack_technique",
]
# Instruction and fallback texts.
DEFAULT_INSTRUCTION = (
    "You are a security analyst. Given the following Windows telemetry event, decide whether it is "
    "benign or malicious and provide a concise explanation grounded in the observed behavior."
)
NO_REASON = "Reason not available."
NO_EXPLANATION = "No explanation generated."
# Prompt texts; <<name>> marks a place that is filled in per row.
REASON_PROMPT = """You are a security analyst specialized in Living-off-the-Land detections.

Event context (JSON):
<<event>>

Model probability: <<score>> (threshold <<threshold>>)

Top SHAP contributions (feature → impact → raw value):
<<contributions>>

Heuristic signals:
<<signals>>

Provide a concise 1–2 sentence explanation (max 80 words) describing why this event is <<label>>. Mention the most relevant signals and how they indicate malicious or benign behavior. Output plain text, no extra JSON.

Reasoning suggestions:
"""
REVIEW_PROMPT = """You are Claude Sonnet-4.5 acting as an independent evaluator.

Event context (JSON):
<<event>>

Original Claude Sonnet output (JSON):
<<verdict>>

Original prompt given to Claude:
<<prompt>>

Our detector prediction (JSON):
<<prediction>>

Ground-truth label (Claude original): <<truth>>

Remember: the llama-based explanation is purely for narrative context; the actual classifier remains a tabular GBDT/XGB/RF model. Do **not** re-evaluate the label itself—focus solely on whether the explanation (`llm_reason`) is reasonable when compared to the original Claude output.

Respond with strict JSON:
{
  "reason_good": true/false,
  "justification": "short text",
  "improvements": ["suggestion1", ...]
}
"""


def fill(template: str, **values: Column) -> Column:
    """The template with its <<name>> places replaced by columns; row text is never re-read as template."""
    parts: list[Column] = []
    rest = template
    while "<<" in rest:
        before, rest = rest.split("<<", 1)
        name, rest = rest.split(">>", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def generated_prompt(time: Column, host: Column, user: Column, image: list[Column], parent: Column, cmd: Column) -> Column:
    """One-line event summary; anything missing reads ``unknown``."""
    return F.concat(
        F.lit("["), or_unknown(time), F.lit("] | Host="), or_unknown(host), F.lit(" | User="), or_unknown(user),
        F.lit(" | Image="), or_unknown(*image), F.lit(" | Parent="), or_unknown(parent), F.lit(" | Cmd="), or_unknown(cmd),
    )


def json_value(c: Column, dtype: str) -> Column:
    """JSON text of a valid value, NULL for a missing or blank one."""
    if dtype == "string":
        return F.when(is_valid_text(c), json_string(c))
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), float_text(c.cast("double")))
    return c.cast("string")


def verdict_struct(c: Column) -> Column:
    """Verdict fields from JSON text; unreadable text gives NULL fields."""
    fields = "reason STRING, attack_technique STRING, confidence STRING, technique STRING, predicted_label STRING"
    return parse_object(strip(c), fields)


def valid_or_null(c: Column) -> Column:
    return F.when(is_valid_text(c), c)


def contribution_bullets(c: Column) -> Column:
    lines = F.transform(
        c,
        lambda x: F.concat(
            F.lit("- "), F.coalesce(x["phrase"], x["feature"]), F.lit(": impact "), fixed(x["impact"], 2, plus=True),
            F.lit(", value="), F.coalesce(x["value"], F.lit("None")),
        ),
    )
    return bullets_or_none(lines)


def signal_bullets(c: Column) -> Column:
    return bullets_or_none(F.transform(c, lambda x: F.concat(F.lit("- "), x)))


def bullets_or_none(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("None")


def reason_or_default(c: Column) -> Column:
    """Generated reason without outer white space; a blank one gets the default text."""
    return F.coalesce(F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(NO_EXPLANATION))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once per row, however often it is used: the lambda binds its value."""
    return F.transform(F.array(c), use)[0]


def parse_model_output(c: Column) -> Column:
    """STRUCT<label, explanation, confidence, numeric_confidence, attack_technique> from generated text.

    The span from the first opening to the last closing brace is read as JSON; if that is no
    object, the whole text is the explanation and the label is unknown.
    """
    schema = "label STRING, explanation STRING, confidence VARIANT, attack_technique STRING"

    def fields(cleaned: Column, parsed: Column) -> Column:
        word = F.lower(parsed["label"])
        return F.struct(
            F.coalesce(F.when(word.isin("malicious", "benign"), word), F.lit("unknown")).alias("label"),
            F.when(parsed.isNotNull(), strip(parsed["explanation"])).otherwise(cleaned).alias("explanation"),
            parsed["confidence"].cast("string").alias("confidence"),
            F.coalesce(F.schema_of_variant(parsed["confidence"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False)).alias(
                "numeric_confidence"
            ),
            parsed["attack_technique"].alias("attack_technique"),
        )

    def read(cleaned: Column) -> Column:
        span = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
        return once(once(span, lambda s: parse_object(s, schema)), lambda parsed: fields(cleaned, parsed))

    return once(strip(c), read)


def _without_fence(c: Column) -> Column:
    """Text without a surrounding code fence (first line, and last line if it is one)."""
    text = strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n", ""), r"(?:^|\n)```[^\n]*\z", "")
    return F.when(text.startswith("```") & text.contains("\n"), strip(inner)).otherwise(text)


def _truthy(v: Column) -> Column:
    """What counts as true: true, non-zero numbers, non-empty texts and lists."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double") != 0)
        .when(kind.isNull() | (kind == "VOID"), F.lit(False))
        .otherwise(~F.to_json(v).isin("[]", "{}")),
        F.lit(False),
    )


def parse_review_response(c: Column) -> Column:
    """STRUCT<reason_good, justification, improvements> from a reviewer's answer."""
    content = _without_fence(c)
    parsed = parse_object(content, "reason_good VARIANT, justification STRING, improvements VARIANT")
    readable = parsed.isNotNull()
    kind = F.schema_of_variant(parsed["improvements"])
    empty = F.array().cast("array<string>")
    listed = F.try_variant_get(parsed["improvements"], "$", "array<string>")
    single = F.array(F.try_variant_get(parsed["improvements"], "$", "string"))
    improvements = (
        F.when(~_truthy(parsed["improvements"]), empty).when(kind.startswith("ARRAY"), listed).otherwise(single)
    )
    return F.struct(
        F.when(readable, _truthy(parsed["reason_good"])).otherwise(False).alias("reason_good"),
        F.when(readable, F.coalesce(parsed["justification"], F.lit("")))
        .otherwise(F.concat(F.lit("Could not parse judge response: "), content))
        .alias("justification"),
        F.when(readable, improvements).otherwise(empty).alias("improvements"),
    )


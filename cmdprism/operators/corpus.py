"""Instruction records, supervised pairs, reason and review prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.functions import payloads as pl
from cmdprism.functions.labels import label_word
from cmdprism.functions.numbers import fixed, float_text
from cmdprism.functions.text import json_object, json_string
from cmdprism.operators.lookups import first_present
from cmdprism.session import LABEL, ROW_ID

#: Records of one file of an exported corpus.
FILE_RECORDS = 1 << 18


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def event_context(df: DataFrame) -> DataFrame:
    """Add ``generated_prompt``, ``input`` (valid context fields) and ``input_text`` (its JSON)."""
    types = dict(df.dtypes)
    c = {name: _column(df, name) for name in pl.CONTEXT_FIELDS}
    prompt = pl.generated_prompt(
        c["EventTime"], c["Hostname"], c["User"], [c["SourceImage"], c["Image"]], c["ParentImage"], c["CommandLine"]
    )
    staged = df.withColumn("generated_prompt", prompt)
    fields = [n for n in pl.CONTEXT_FIELDS if n in types]
    values = {n: pl.json_value(c[n], types[n]) for n in fields}
    values["generated_prompt"] = json_string(F.col("generated_prompt"))
    kept = [F.when(values[n].isNotNull(), c[n]).alias(n) for n in fields]
    return staged.withColumns(
        {"input": F.struct(*kept, "generated_prompt"), "input_text": json_object(values, skip_null=True)}
    )


def output_payload(df: DataFrame, verdict: str = "verdict_json") -> DataFrame:
    """Add ``output`` (label, explanation, attack_technique, confidence) and ``output_text`` (its JSON).

    The verdict column is JSON text or a struct with the same fields.
    """
    if verdict not in df.columns:
        df = df.withColumn(verdict, F.lit(None).cast("string"))
    is_text = dict(df.dtypes)[verdict] == "string"
    staged = df.withColumn("_verdict", pl.verdict_struct(F.col(verdict)) if is_text else F.col(verdict))
    known = set(staged.schema["_verdict"].dataType.fieldNames())

    def part(name: str) -> Column:
        return F.col(f"_verdict.{name}") if name in known else F.lit(None).cast("string")

    reason = first_present(part("reason"), _column(df, "reason"))
    attack = first_present(part("attack_technique"), _column(df, "_attack_technique"), part("technique"))
    staged = staged.withColumn(
        "output",
        F.struct(
            label_word(F.col(LABEL)).alias("label"),
            F.coalesce(pl.valid_or_null(reason), F.lit(pl.NO_REASON)).alias("explanation"),
            pl.valid_or_null(attack).alias("attack_technique"),
            pl.valid_or_null(part("confidence")).alias("confidence"),
        ),
    )
    names = ["label", "explanation", "attack_technique", "confidence"]
    text = json_object(
        {n: F.when(F.col(f"output.{n}").isNotNull(), json_string(F.col(f"output.{n}"))) for n in names}, skip_null=True
    )
    return staged.withColumn("output_text", text).drop("_verdict")


def instruction_records(
    df: DataFrame, split: Column | str, instruction: str = pl.DEFAULT_INSTRUCTION, verdict: str = "verdict_json"
) -> DataFrame:
    """One instruction/response record per event, with the rendered texts."""
    staged = output_payload(event_context(df), verdict)
    split_column = F.lit(split) if isinstance(split, str) else split
    prompt = F.concat(F.lit(f"{instruction}\n\nContext:\n"), F.col("input_text"))
    return staged.select(
        F.col(ROW_ID).cast("bigint").alias(ROW_ID),
        split_column.alias("split"),
        F.lit(instruction).alias("instruction"),
        "input",
        "output",
        "input_text",
        "output_text",
        prompt.alias("formatted_prompt"),
        F.col("output_text").alias("formatted_response"),
    )


def export_corpus(
    df: DataFrame, splits: DataFrame, path: str, names: tuple[str, ...] = ("train", "val", "test"),
    instruction: str = pl.DEFAULT_INSTRUCTION,
) -> dict[str, int]:
    """Write one folder of JSON-Lines files, packed by gzip, per split and return the record counts; none at all is an error.

    A record says the same in parts and rendered, so it packs to a small part of its size. A packed file is read by one task.
    """
    wanted = splits.where(F.col("split").isin(*names)).select(ROW_ID, "split")
    records = instruction_records(df.join(wanted, ROW_ID), F.col("split"), instruction)
    writer = records.write.mode("overwrite").partitionBy("split").option("maxRecordsPerFile", FILE_RECORDS)
    writer.json(path, compression="gzip")
    written = df.sparkSession.read.schema("row_id BIGINT, split STRING").json(path).groupBy("split").agg(F.count("*").alias("n"))
    counts = {r["split"]: r["n"] for r in written.collect()}
    if not counts:
        raise ValueError("no records written: check splits and events")
    return counts


def supervised_pairs(df: DataFrame) -> DataFrame:
    """Prompt and response of every record, rendered from its parts where no text is stored."""

    def as_text(name: str) -> Column:
        if name not in df.columns:
            return F.lit("null")
        return F.col(name) if dict(df.dtypes)[name] == "string" else F.to_json(name)

    instruction = F.coalesce(_column(df, "instruction"), F.lit(""))
    body = first_present(_column(df, "input_text"), as_text("input"))
    prompt = F.concat(instruction, F.lit("\n\nContext:\n"), body)
    response = first_present(_column(df, "output_text"), as_text("output"))
    return df.select(
        *[c for c in (ROW_ID, "split") if c in df.columns],
        first_present(_column(df, "formatted_prompt"), prompt).alias("prompt"),
        first_present(_column(df, "formatted_response"), response).alias("response"),
    )


def render_reason_prompt(explained: DataFrame, out: str = "reason_prompt") -> DataFrame:
    """Prompt that asks for a short reason, from an explanation record with its event texts."""
    event = json_object(
        {
            "row_id": F.coalesce(F.col(ROW_ID).cast("string"), F.lit("null")),
            "CommandLine": json_string(F.col("CommandLine")),
            "SourceImage": json_string(F.col("SourceImage")),
        }
    )
    text = pl.fill(
        pl.REASON_PROMPT,
        event=event,
        score=fixed(F.coalesce(F.col("score"), F.lit(0.0)), 3),
        threshold=fixed(F.coalesce(F.col("threshold"), F.lit(0.0)), 3),
        contributions=pl.contribution_bullets(F.col("contributions")),
        signals=pl.signal_bullets(F.col("signals")),
        label=F.upper(F.coalesce(F.col("label"), F.lit("unknown"))),
    )
    return explained.withColumn(out, text)


def render_review_prompt(inputs: DataFrame, out: str = "review_prompt") -> DataFrame:
    """Prompt that asks a reviewer to judge a reason, from ``build_review_inputs`` rows."""
    event = json_object({n: json_string(F.col(n)) for n in ("CommandLine", "SourceImage", "prompt")})
    prediction = json_object(
        {
            "label": json_string(F.col("prediction.label")),
            "score": F.coalesce(float_text(F.col("prediction.score")), F.lit("null")),
            "llm_reason": json_string(F.col("prediction.llm_reason")),
            "note": json_string(F.col("prediction.note")),
        }
    )
    text = pl.fill(
        pl.REVIEW_PROMPT,
        event=event,
        verdict=F.coalesce(F.col("verdict_json"), F.lit("{}")),
        prompt=F.coalesce(F.col("prompt"), F.lit("")),
        prediction=prediction,
        truth=F.coalesce(F.col("ground_truth").cast("string"), F.lit("None")),
    )
    return inputs.withColumn(out, text)

"""Scoring of an event stream: with the batch expressions, or with trained detectors that may be replaced while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cmdprism.functions.features import build_features
from cmdprism.operators.models import Detector, load_detector, save_detector
from cmdprism.operators.scoring import label_at, score_table
from cmdprism.session import LABEL, ROW_ID


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """JSON-Lines files that arrive in a folder, as a stream; malformed lines come out as NULL rows."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append scored events to a Parquet folder; the file sink's log makes a replayed batch idempotent."""
    writer = score(stream).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish_detectors(spark: SparkSession, detectors: list[Detector], path: str, version: int) -> None:
    """Save detectors as a version. The row that names it is written last, so a reader never sees half a version."""
    for detector in detectors:
        save_detector(spark, detector, f"{path}/v{version}/{detector.name}")
    names = spark.createDataFrame([(version, [d.name for d in detectors])], "version INT, names ARRAY<STRING>")
    names.write.mode("append").parquet(f"{path}/versions")


class CurrentDetectors:
    """The newest published version; it is loaded again when a newer one stands there."""

    def __init__(self, path: str, encoders: dict[str, Callable] | None = None) -> None:
        self.path, self.encoders = path, encoders or {}
        self.version: int | None = None
        self.detectors: list[Detector] = []

    def get(self, spark: SparkSession) -> tuple[int, list[Detector]]:
        newest = spark.read.parquet(f"{self.path}/versions").agg(F.max_by(F.struct("version", "names"), "version").alias("v")).first()["v"]
        if newest["version"] != self.version:
            base = f"{self.path}/v{newest['version']}"
            self.detectors = [load_detector(spark, f"{base}/{name}", self.encoders.get(name)) for name in newest["names"]]
            self.version = newest["version"]
        return self.version, self.detectors


def score_batch_into(batch: DataFrame, batch_id: int, current: CurrentDetectors, out: str, threshold: float = 0.5) -> None:
    """Score one micro-batch into the folder of its id, which a replayed batch replaces as a whole."""
    version, detectors = current.get(batch.sparkSession)
    features = build_features(batch)
    for detector in detectors:
        features = detector.score(features)
    rows = score_table(features, [d.name for d in detectors], LABEL, ROW_ID)
    scored = label_at(rows, "prob", threshold).withColumn("version", F.lit(version))
    scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def score_stream_with(
    stream: DataFrame, models: str, out: str, checkpoint: str, encoders: dict[str, Callable] | None = None,
    threshold: float = 0.5, once: bool = True,
) -> StreamingQuery:
    """Score a stream with the detectors published under ``models``: (row_id, label, model, prob, prediction, version) per batch folder.

    A batch whose commit was lost runs again under the same id and writes the same folder, so no row comes twice.
    """
    current = CurrentDetectors(models, encoders)
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: score_batch_into(batch, batch_id, current, out, threshold))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

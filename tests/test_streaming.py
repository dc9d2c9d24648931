"""Trained detectors on a stream: replay and reload."""

import pytest
from pyspark.sql import functions as F

from cmdprism.catalog.telemetry import telemetry
from cmdprism.functions.features import build_features
from cmdprism.operators import models
from cmdprism.sources.events import write_jsonl
from cmdprism.streaming import scoring as st

SCHEMA = "row_id BIGINT, CommandLine STRING, SourceImage STRING, _label INT"


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return build_features(telemetry(spark, sf_dir)).cache()


def rows_of(spark, out):
    return sorted((r["row_id"], r["model"], r["prob"], r["version"]) for r in spark.read.parquet(out).collect())


def test_replay_changes_nothing_and_a_new_version_is_taken_up(spark, events, tmp_path):
    base = str(tmp_path)
    first = [models.train_random_forest(events, {"n_estimators": 3}), models.train_text_lr(events, max_iter=5)]
    st.publish_detectors(spark, first, f"{base}/models", 1)
    write_jsonl(events.select("row_id", "CommandLine", "SourceImage", "_label").repartition(3), f"{base}/in")
    stream = st.event_stream(spark, f"{base}/in", SCHEMA, max_files=1)
    st.score_stream_with(stream, f"{base}/models", f"{base}/out", f"{base}/log").awaitTermination()
    want = rows_of(spark, f"{base}/out")
    assert len(want) == 2 * events.count() and {w[3] for w in want} == {1}
    # The same batches again, as after a lost commit: a new log gives the same ids to the same files.
    st.score_stream_with(stream, f"{base}/models", f"{base}/out", f"{base}/log-2").awaitTermination()
    assert rows_of(spark, f"{base}/out") == want
    # Rows equal the batch form.
    batch = events
    for detector in first:
        batch = detector.score(batch)
    expected = {(r["row_id"], n): r[f"prob_{n}"] for r in batch.collect() for n in ("rf", "text")}
    assert all(abs(expected[i, n] - p) < 1e-12 for i, n, p, _ in want)
    # A later version is loaded by the next batch; what is written stays.
    st.publish_detectors(spark, [models.train_gbdt(events, {"n_estimators": 2})], f"{base}/models", 2)
    write_jsonl(events.select((F.col("row_id") + 10_000).alias("row_id"), "CommandLine", "SourceImage", "_label").limit(50), f"{base}/more")
    (spark.read.schema(SCHEMA).json(f"{base}/more").coalesce(1).write.mode("append").json(f"{base}/in"))
    st.score_stream_with(stream, f"{base}/models", f"{base}/out", f"{base}/log").awaitTermination()
    later = [r for r in rows_of(spark, f"{base}/out") if r[0] >= 10_000]
    assert len(later) == 50 and {(n, v) for _, n, _, v in later} == {("gbdt", 2)}
    assert [r for r in rows_of(spark, f"{base}/out") if r[0] < 10_000] == want


def test_one_loader_serves_all_batches(spark, events, tmp_path):
    path = f"{tmp_path}/models"
    st.publish_detectors(spark, [models.train_gbdt(events, {"n_estimators": 1})], path, 1)
    current = st.CurrentDetectors(path)
    version, detectors = current.get(spark)
    assert version == 1 and current.get(spark)[1] is detectors


def test_a_text_model_in_table_form_is_published(spark, events, tmp_path, monkeypatch):
    from cmdprism.operators import textmodel

    monkeypatch.setattr(textmodel, "DRIVER_TERMS", 10)
    few = events.where("row_id < 60")
    detector = models.train_text_lr(few, max_iter=3)
    st.publish_detectors(spark, [detector], f"{tmp_path}/models", 1)
    raw = few.select("row_id", "CommandLine", "SourceImage", "_label")
    st.score_batch_into(raw, 0, st.CurrentDetectors(f"{tmp_path}/models"), f"{tmp_path}/out")
    want = {r["row_id"]: r["prob_text"] for r in detector.score(few).collect()}
    got = rows_of(spark, f"{tmp_path}/out")
    assert detector.weights is not None and len(got) == len(want) and all(abs(want[i] - p) < 1e-12 for i, _, p, _ in got)

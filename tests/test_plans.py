"""Plan shapes: pruned scans, semi joins, no filter that computes keys again."""

from cmdprism.catalog.telemetry import telemetry
from cmdprism.functions.features import build_features
from cmdprism.operators import splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_read_only_their_columns(spark, tmp_path, sf_dir):
    path = str(tmp_path / "t")
    telemetry(spark, sf_dir).write.parquet(path)
    wanted = build_features(spark.read.parquet(path)).where("row_id > 10").select("row_id", "has_cmd")
    text = plan(wanted)
    assert "ReadSchema: struct<row_id:bigint,CommandLine:string>" in text
    assert "GreaterThan(row_id,10)" in text


def test_split_semi_join_and_one_scan_of_the_texts(spark, tmp_path, sf_dir):
    path = str(tmp_path / "t")
    telemetry(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    text = plan(splits.select_split(rows, spark.range(5).selectExpr("id AS row_id", "'train' AS split"), "train"))
    assert "LeftSemi" in text
    from cmdprism.operators.ingest import add_group_key

    stats = plan(splits.group_label_stats(add_group_key(rows)))
    assert "- Filter" not in stats and stats.count("FileScan") == 1


def test_scratch_tables_are_cleared_per_application(spark, tmp_path, monkeypatch):
    """Over a folder of its own, so that tables of other tests stay."""
    import os

    from cmdprism import session
    from cmdprism.sources.tables import materialize

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    written = materialize(spark.range(5).toDF("x"), "numbers")
    assert written.count() == 5 and os.listdir(f"{tmp_path}/cmdprism") == [spark.sparkContext.applicationId]
    keep = f"{tmp_path}/cmdprism/other-application"
    os.makedirs(keep)
    session.clear_scratch(spark)
    assert os.listdir(f"{tmp_path}/cmdprism") == ["other-application"]


def test_long_hot_keys_are_not_forced_into_a_broadcast(spark, monkeypatch):
    from cmdprism.plans import skew
    from cmdprism.sources.tables import materialize

    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN repeat('k', 300) ELSE concat('x', id) END AS key")
    groups = materialize(rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "length(key) AS size_"), "groups")
    for bound in (skew.HOT_BYTES, 1000):
        monkeypatch.setattr(skew, "HOT_BYTES", bound)
        found = skew.attach_group_values(rows, groups, "key", "n", ["size_"], "id")
        assert found.count() == 4000 and found.where("size_ <> length(key)").count() == 0

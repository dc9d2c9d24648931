"""Detectors, stacking, saving, attribution, streaming."""

import random
from functools import reduce

import numpy as np
import pytest
from pyspark.ml.feature import IDF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdprism.catalog.scored import WEIGHTS
from cmdprism.catalog.telemetry import telemetry
from cmdprism.functions.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, build_features
from cmdprism.operators import explain as ex
from cmdprism.operators import metrics, models, scoring, textmodel
from cmdprism.session import scratch_path


# One label in ten is noise by construction, which limits any detector to an AUC of about 0.88.
GOOD_AUC = 0.8


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return build_features(telemetry(spark, sf_dir)).cache()


def auc(scored, column):
    df = scored.select("_label", F.col(column).alias("score"))
    return metrics.ranking_metrics(metrics.ranked_scores(df)).first()["roc_auc"]


@pytest.fixture(scope="module")
def forest(events):
    return models.train_random_forest(events, {"n_estimators": 6, "max_depth": 4})


@pytest.fixture(scope="module")
def text(events):
    return models.train_text_lr(events, min_df=2, max_iter=10)


def test_trees_separate_the_classes(events, forest):
    boosted = models.train_gbdt(events, {"n_estimators": 8, "learning_rate": 0.3})
    assert auc(forest.score(events), "prob_rf") > GOOD_AUC
    assert auc(boosted.score(events), "prob_gbdt") > GOOD_AUC
    assert boosted.config["feature_type"] == "categorical" and forest.config["feature_type"] == "ohe"


def test_text_model(events, text):
    assert auc(text.score(events), "prob_text") > GOOD_AUC
    assert "findstr" in text.feature_names and "cmd exe" in text.feature_names


def test_equal_texts_are_one_row_of_the_regression(spark, events, monkeypatch):
    few = events.where("CommandLine IS NULL OR CommandLine NOT LIKE 'powershell%'").select("row_id", "CommandLine", "_label")
    merged = few.select("CommandLine", "_label").distinct().count()
    read, plain = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: (read.append(df.count()), plain(self, df))[1])
    model = models.train_text_lr(few)
    models.train_embedding_lr(few, lambda: lambda texts: [[float(len(t))] for t in texts], max_iter=5)
    assert read == [merged, merged] and merged < few.count()
    # The same regression over all rows one by one, with Spark's own document frequencies.
    weighted = models.with_class_weight(few)
    rows = model.pipeline.stages[0].transform(textmodel.with_terms(weighted))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(rows).idf.toArray() + 1.0
    assert np.allclose(idf, model.pipeline.stages[1].getScalingVec().toArray(), rtol=1e-12)
    vectors = model.pipeline.stages[2].transform(model.pipeline.stages[1].transform(rows))
    lone = plain(models.logistic_regression(models.TEXT_C, few.count()), vectors)
    assert np.allclose(lone.coefficients.toArray(), model.pipeline.stages[3].coefficients.toArray(), atol=0.02)
    assert textmodel.fit_vectorizer(rows.select("terms", F.lit(2).alias("n")), min_df=2, times="n").stages[0].vocabulary


def test_embedding_model_with_an_injected_encoder(events):
    def make_encoder():
        return lambda texts: [[float(len(t)), float(sum(c.isdigit() for c in t))] for t in texts]

    model = models.train_embedding_lr(events.select("row_id", "CommandLine", "_label"), make_encoder, max_iter=10)
    assert model.feature_names == ["embedding_0", "embedding_1"]
    bounds = model.score(events).agg(F.min("prob_st"), F.max("prob_st")).first()
    assert 0.0 <= bounds[0] <= bounds[1] <= 1.0
    with pytest.raises(ValueError):
        models.train_embedding_lr(events.select("CommandLine", "_label"))


def test_saved_detector_gives_the_same_scores(spark, events, forest, text):
    for detector in (forest, text):
        path = scratch_path(spark, "detector")
        models.save_detector(spark, detector, path)
        (provider,) = models.providers_from_metadata(spark, [{"name": "again", "type": detector.kind, "path": path}])
        both = provider[1](detector.score(events))
        assert both.where(F.abs(F.col("prob_again") - F.col(f"prob_{detector.name}")) > 1e-12).count() == 0
    with pytest.raises(ValueError):
        models.providers_from_metadata(spark, [{"name": "x", "type": "neural", "path": path}])


def test_stacked_ensemble(events, forest, text):
    chosen = models.default_providers({"rf": forest, "text": text})
    assert [d.name for d in chosen] == ["rf", "text"]
    providers = [d.provider() for d in chosen]
    model, columns = models.train_stacked_ensemble(events, providers, max_iter=10)
    assert columns == ["prob_rf", "prob_text"]
    assert auc(models.score_ensemble(events, model, providers), "prob_ensemble") > GOOD_AUC
    with pytest.raises(ValueError):
        models.default_providers({"rf": forest})


def test_vocabulary_is_bounded_by_its_parameters_only(spark):
    df = spark.createDataFrame([("aa bb cc",), ("aa bb dd",), (None,)], "CommandLine STRING")
    terms = textmodel.with_terms(df)
    assert len(textmodel.fit_vectorizer(terms).stages[0].vocabulary) == 7
    assert set(textmodel.fit_vectorizer(terms, min_df=2).stages[0].vocabulary) == {"aa", "bb", "aa bb"}
    assert len(textmodel.fit_vectorizer(terms, max_features=3).stages[0].vocabulary) == 3


def test_terms_are_counted_within_the_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])], "row_id INT, terms ARRAY<STRING>")
    got = {(r.row_id, r.term, r.tf) for r in textmodel.term_counts(df).collect()}
    assert got == {(1, "a", 1), (1, "b", 2), (4, "c", 1)}


def test_accents_and_grams(spark):
    df = spark.createDataFrame([("Déjà  vu, x ÉTÉ",)], "CommandLine STRING")
    assert textmodel.with_terms(df).first()["terms"] == ["deja", "vu", "ete", "deja vu", "vu ete"]
    one = spark.createDataFrame([("Solo",), ("",), (None,)], "CommandLine STRING")
    assert [r.terms for r in textmodel.with_terms(one).collect()] == [["solo"], [], []]


def test_every_category_keeps_its_index(spark):
    rows = [(i, f"v{i % 1500}" if i % 3 else "hot") for i in range(4000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "row_id BIGINT, source_image_base STRING")
    tables = models.category_tables(df, ["source_image_base"])
    sizes = models.table_sizes(tables)
    values = {v or "unknown" for _, v in rows}
    assert sizes == {"source_image_base": len(values)} and len(values) > 1000
    found = models.with_category_indexes(df, tables, sizes).collect()
    index = {r.source_image_base or "unknown": r.source_image_base_index for r in found}
    assert len(found) == len(rows) and sorted(index.values()) == [float(i) for i in range(len(values))]
    assert index["hot"] == 0.0
    new = spark.createDataFrame([(1, "never seen")], "row_id BIGINT, source_image_base STRING")
    assert models.with_category_indexes(new, tables, sizes).first().source_image_base_index == float(len(values))


@pytest.mark.parametrize("method", ["shapley", "path"])
def test_tree_contributions_add_up_to_the_score(events, forest, method):
    rows, base = ex.tree_contributions(forest, events, 100, method)
    total = F.aggregate("contributions", F.lit(base), lambda acc, c: acc + c["impact"])
    worst = rows.agg(F.max(F.abs(total - F.col("score")))).first()[0]
    assert worst < 0.005  # impacts below the reporting limit are left out
    boosted = models.train_gbdt(events, {"n_estimators": 10, "learning_rate": 0.3})
    rows, base = ex.tree_contributions(boosted, events, 100, method)
    margin = F.log(F.col("score") / (1 - F.col("score")))
    total = F.aggregate("contributions", F.lit(base), lambda acc, c: acc + c["impact"])
    assert rows.agg(F.max(F.abs(total - margin))).first()[0] < 0.005


@pytest.mark.parametrize("method", ["shapley", "path"])
def test_equal_inputs_are_attributed_once(spark, events, forest, monkeypatch, method):
    copies = reduce(DataFrame.unionByName, [events.withColumn("row_id", F.col("row_id") + k * 1_000_000) for k in range(4)])
    different = events.select(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES).distinct().count()
    want = {r.row_id: (r.score, r.contributions) for r in ex.tree_contributions(forest, events, 3, method)[0].collect()}
    seen, plain = spark.sparkContext.accumulator(0), ex.Attribution.impacts

    def impacts(self, method, x, codes):
        seen.add(len(x))
        return plain(self, method, x, codes)

    monkeypatch.setattr(ex.Attribution, "impacts", impacts)
    rows = ex.tree_contributions(forest, copies, 3, method)[0].collect()
    assert seen.value == different < events.count()
    assert len(rows) == 4 * len(want) and all(want[r.row_id % 1_000_000] == (r.score, r.contributions) for r in rows)


def test_linear_contributions_add_up_to_the_margin(events):
    weights, intercept = WEIGHTS["shape"]
    means = ex.feature_means(events, list(weights))
    rows = ex.linear_contributions(events, weights, means, top_k=10)
    base = intercept + sum(w * means[n] for n, w in weights.items())
    total = F.aggregate("contributions", F.lit(base), lambda acc, c: acc + c["impact"])
    assert rows.agg(F.max(F.abs(total - scoring.linear_margin(weights, intercept)))).first()[0] < 1e-3


def test_explain_wording(spark):
    rows = [
        (1, 'powershell.exe -enc aGVsbG8= -Command "Invoke-WebRequest http://example.com"', 0.9),
        (2, "cmd.exe /c echo hello world", 0.2), (3, "notepad", 0.9),
    ]
    df = spark.createDataFrame(rows, "row_id INT, CommandLine STRING, score DOUBLE").withColumn("SourceImage", F.lit("C:\\a.exe"))
    one, two, three = ex.explain(build_features(df), top_k=2).orderBy("row_id").collect()
    assert (one.label, two.label) == ("malicious", "benign") and len(one.signals) == 2
    assert one.explanation == "Flagged due to: Invokes PowerShell, Uses EncodedCommand obfuscation."
    assert two.explanation == "Predicted benign; no high-risk features triggered."
    assert three.explanation.startswith("Flagged by the GBDT model despite")


def test_tuning_ranks_the_grid(events):
    out = models.tune(events, "xgb", {"max_depth": [1, 3]}, folds=2, base={"n_estimators": 5}).collect()
    assert len(out) == 2 and {r["n_scored"] for r in out} == {events.count()} and out[0].avg_macro_f1 >= out[1].avg_macro_f1
    with pytest.raises(ValueError):
        models.tune(events, "svm")


def test_models_are_tuned_on_shared_bins(events, monkeypatch):
    grid, base = {"max_depth": [1, 3]}, {"n_estimators": 3}
    alone = {m: models.tune(events, m, grid, folds=2, base=base).collect() for m in ("xgb", "rf")}
    bins = models.folded_bins(events, 2)
    monkeypatch.setattr(models, "binned_features", None)
    assert {m: models.tune(events, m, grid, folds=2, base=base, bins=bins).collect() for m in ("xgb", "rf")} == alone


def test_latency_of_unmeasured_models_is_zero(spark, events):
    runs = models.measure_latency("value", events.withColumn("prob_value", F.col("score")), runs=2)
    names = spark.createDataFrame([("value",), ("outside",)], "model STRING")
    got = {r.model: r for r in models.latency_stats(runs, names).collect()}
    assert got["value"].runs == 2 and got["value"].total_seconds > 0 and got["outside"].total_seconds == 0


def test_published_grids():
    assert [len(models.grid_points(m)) for m in models.TREE_MODELS] == [12, 9, 4]
    assert models.grid_points("gbdt")[0] == {"learning_rate": 0.03, "num_leaves": 31, "reg_lambda": 0.0}
    assert models.grid_points("rf")[-1] == {"max_depth": 20, "n_estimators": 500}


def test_accent_folding_equals_full_decomposition_on_every_code_point(spark):
    import unicodedata

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = [(i, "".join(chars[i : i + 500])) for i in range(0, len(chars), 500)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", textmodel.strip_accents(F.col("t")).alias("s")).collect()
    want = {i: "".join(c for c in "".join(unicodedata.normalize("NFKD", x) for x in t) if not unicodedata.combining(c)) for i, t in rows}
    assert {r["i"]: r["s"] for r in got} == want


def test_table_regression_equals_mllib(spark):
    """Weights within 1e-6 of MLlib's at a tight tolerance; a row without entries has the intercept as margin."""
    import random

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from cmdprism.operators import sparse_lr
    from cmdprism.sources.tables import materialize

    rng = random.Random(2)
    width, n = 20, 80
    x = [{j: rng.gauss(0, 1) for j in rng.sample(range(width), 5)} if i else {} for i in range(n)]
    y = [int(sum(v * (1 if j % 3 else -1) for j, v in row.items()) + rng.gauss(0, 1.5) > 0) for row in x]
    weight = [1.0 + (i % 3) / 2 for i in range(n)]
    total = sum(weight)
    dense = spark.createDataFrame([(float(a), w, Vectors.sparse(width, row)) for a, w, row in zip(y, weight, x)], ["label", "w", "features"])
    wanted = LogisticRegression(weightCol="w", regParam=1.0 / (2.0 * total), standardization=False, tol=1e-14, maxIter=1000).fit(dense)
    entries = spark.createDataFrame([(i, f"t{j}", v) for i, row in enumerate(x) for j, v in row.items()], "row long, term string, x double")
    labels = spark.createDataFrame(list(zip(range(n), y, weight)), "row long, y int, weight double")
    fitted = sparse_lr.fit(materialize(entries, "entries"), materialize(labels, "labels"), 2.0, tolerance=1e-9)
    got = {r["term"]: r["weight"] for r in fitted.weights.collect()}
    assert max(abs(got[f"t{j}"] - wanted.coefficients[j]) for j in range(width)) < 1e-6
    assert abs(fitted.intercept - wanted.intercept) < 1e-6 and fitted.slope < 1e-9


def test_table_text_model_equals_the_vector_model(events):
    from cmdprism.operators import sparse_lr

    few = events.where("row_id < 60")
    table = sparse_lr.train_text_table(few, tolerance=1e-6)
    vector = models.train_text_lr(few)
    both = vector.score(table.score(events, "prob_table")).select(F.abs(F.col("prob_table") - F.col("prob_text")).alias("d"))
    assert both.count() == events.count() and both.agg(F.max("d")).first()[0] < 2e-3


def test_a_model_is_held_against_the_base_rate_of_its_training_rows(spark):
    """A split of one kind of event: the right rate of that kind passes, what a model without any feature gives doesn't."""
    from cmdprism.catalog.text_queries import base_rate, trained_checks

    train = spark.createDataFrame([(int(i < 36),) for i in range(100)], "_label int")
    rate = base_rate(train)
    assert rate == 0.36
    rows = [("learned", 0.9, int(i % 10 > 0)) for i in range(50)] + [("constant", rate, int(i % 10 > 0)) for i in range(50)]
    scores = spark.createDataFrame(rows, "split string, prob_any double, _label int")
    found = {r["split"]: r["beats_base_rate"] for r in trained_checks(scores, "any", rate).collect()}
    assert found == {"learned": True, "constant": False}


def test_columns_are_summed_by_entries(spark):
    """Entries of sparse and dense vectors; no aggregate of a query holds a vector as wide as the vocabulary or the categories."""
    from pyspark.ml.linalg import Vectors

    from cmdprism.catalog import all_queries
    from cmdprism.operators.textmodel import vector_entries

    df = spark.createDataFrame([(Vectors.sparse(4, [1, 3], [2.0, 0.0]),), (Vectors.dense(1.0, 0.0, 5.0, 0.0),), (Vectors.sparse(4, [], []),)], ["v"])
    found = sorted((r["pos"], r["x"]) for r in df.select(F.inline(vector_entries(F.col("v")))).collect())
    assert found == [(0, 1.0), (1, 2.0), (2, 5.0)]
    for name in ("h3_vectorizer_matches_long_form", "c27_one_hot"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unwrap_udt" in plan and "summar" not in plan and "vector_to_array" not in plan


def test_table_regression_takes_few_rounds_where_terms_differ_in_size(spark):
    """Terms of rows that stand for many beside terms of single rows: 8 rounds, 27 without the scale."""
    from cmdprism.operators import sparse_lr
    from cmdprism.sources.tables import materialize

    entries, labels = [], []
    for i in range(40):
        terms = [(f"tool{i % 4}", 0.6), ("run", 0.1), (f"u{i % 7}", 0.6), *([(f"only{i}", 0.9)] if i % 2 else [])]
        entries += [(i, t, x) for t, x in terms]
        labels.append((i, (i % 7 + i % 4) % 5 / 10 + 0.1, 1.0 if i % 2 else 10000.0))
    entries = materialize(spark.createDataFrame(entries, "row long, term string, x double").coalesce(1), "entries")
    labels = materialize(spark.createDataFrame(labels, "row long, y double, weight double").coalesce(1), "labels")
    fitted = sparse_lr.fit(entries, labels, 2.0, tolerance=1e-5, n_rows=200020)
    assert fitted.slope <= 1e-5 and fitted.rounds <= 15


def test_equal_texts_are_one_row_of_the_table_regression(spark):
    from cmdprism.operators import sparse_lr

    rows = [(10 * i + k, f"tool{i} run" if i else None, int(i < 2 or k == 0)) for i in range(4) for k in range(3)]
    fitted = sparse_lr.train_text_table(spark.createDataFrame(rows, "row_id long, CommandLine string, _label int").coalesce(1), max_rounds=1)
    found = {r["term"]: (r["df"], r["corpus_tf"]) for r in fitted.vocabulary.collect()}
    assert found["run"] == (9, 9) and found["tool2"] == (3, 3) and found["tool3 run"] == (3, 3) and len(found) == 7
    # The written labels: one row for each text, the empty one included, with the mean label by weight.
    assert fitted.model.rounds == 1


def test_rows_of_weights_are_summed_alike(spark):
    rows = [(1, "One two two"), (2, "two  three\u2003four two"), (3, ""), (4, "x"), (5, "été one")]
    df = textmodel.with_terms(spark.createDataFrame(rows, "row_id BIGINT, CommandLine STRING"))
    counts = textmodel.term_counts(df)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    # No lambda compares the words of a row, and white space is not collapsed before words are taken.
    assert "array_sort" not in plan and "regexp_replace" not in plan
    counts = counts.cache()
    vocabulary = textmodel.fit_tfidf(counts, 5).cache()
    plain = textmodel.transform_tfidf(counts, vocabulary).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("tfidf").alias("s"), F.max("tfidf").alias("m"))
    want = {r.row_id: (r.n, pytest.approx(r.s), pytest.approx(r.m)) for r in plain.collect()}
    assert {r.row_id: (r.n_terms, r.total, r.top) for r in textmodel.summarize_tfidf(counts, vocabulary).collect()} == want and set(want) == {1, 2, 5}


@pytest.fixture(scope="module")
def large_text(events):
    """A text model whose vocabulary is more than the driver may hold."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(textmodel, "DRIVER_TERMS", 10)
        return models.train_text_lr(events.where("row_id < 120"))


def test_a_vocabulary_too_large_for_the_driver_is_a_table(spark, events, large_text):
    assert large_text.pipeline is None and large_text.feature_names == []
    assert large_text.weights.vocabulary.count() > 10
    vector = models.train_text_lr(events.where("row_id < 120"))
    assert vector.pipeline is not None
    # Rows that come twice, without a text or without a key are scored like any others.
    odd = events.select("row_id", "CommandLine", "_label").where("row_id < 200")
    odd = odd.unionByName(odd.limit(3)).unionByName(spark.createDataFrame([(None, None, 1), (None, "", 0)], "row_id BIGINT, CommandLine STRING, _label INT"))
    both = vector.score(large_text.score(odd, "prob_table")).select(F.abs(F.col("prob_table") - F.col("prob_text")).alias("d"))
    assert both.agg(F.count("d"), F.max("d")).first()[0] == odd.count() and both.agg(F.max("d")).first()[0] < 5e-3


def test_a_large_text_model_is_saved_and_stacked(spark, events, forest, large_text):
    path = scratch_path(spark, "large-text")
    models.save_detector(spark, large_text, path)
    (provider,) = models.providers_from_metadata(spark, [{"name": "again", "type": "tfidf", "path": path}])
    few = events.where("row_id < 200")
    both = provider[1](large_text.score(few))
    assert both.count() == few.count() and both.where(F.abs(F.col("prob_again") - F.col("prob_text")) > 1e-12).count() == 0
    pair = [d.provider() for d in models.default_providers({"rf": forest, "text": large_text})]
    model, _ = models.train_stacked_ensemble(few, pair, max_iter=5)
    assert auc(models.score_ensemble(few, model, pair), "prob_ensemble") > GOOD_AUC


def test_providers_of_an_ensemble_are_scored_once(spark, events, text):
    """The regression's rounds read what the providers gave, not the providers."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watch(p):
        seen.add(1)
        return p

    name, score = text.provider()
    few = events.where("row_id < 100")
    models.train_stacked_ensemble(few, [(name, lambda df: score(df).withColumn("prob_text", watch("prob_text")))], max_iter=5)
    assert seen.value == few.count()


def test_vectors_by_a_vocabulary_table_equal_the_pipeline(spark, monkeypatch):
    rows = [(1, "one two two"), (1, "one two two"), (2, "two three"), (3, ""), (4, None), (5, "été one x1")]
    terms = textmodel.with_terms(spark.createDataFrame(rows, "id INT, CommandLine STRING"))

    def entries(model):
        named = textmodel.vocabulary_table(spark, model)
        found = model.transform(terms)
        assert found.count() == len(rows) and "vector" in dict(found.dtypes)["features"]
        columns = found.select("id", F.inline(textmodel.vector_entries(F.col("features")))).join(named, "pos")
        return sorted((r["id"], r["term"], round(r["x"], 9)) for r in columns.collect())

    for limits in ({}, {"min_df": 2}):
        want = entries(textmodel.fit_vectorizer(terms, **limits))
        with monkeypatch.context() as patch:
            patch.setattr(textmodel, "DRIVER_TERMS", 1)
            table = textmodel.fit_vectorizer(terms, **limits)
            assert isinstance(table, textmodel.TableVectorizer)
            assert entries(table) == want and want
    with monkeypatch.context() as patch:
        patch.setattr(textmodel, "DRIVER_BYTES", 8)
        assert isinstance(textmodel.fit_vectorizer(terms), textmodel.TableVectorizer)

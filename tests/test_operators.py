"""Operators against brute force on small fixtures, with ties, NULLs and very large groups."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cmdprism.operators import corpus, costs, ingest, lookups, metrics, rules, splits
from cmdprism.plans import prefix
from cmdprism.plans.prefix import rank_in_order, running_totals
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import shared_dir
from cmdprism.sources import events, tables


@pytest.fixture(scope="module")
def scores(spark):
    """Three groups; a third of all rows share one score, and some rows have none."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        score = 0.25 if i % 3 == 0 else round(rng.random(), 2 if i % 2 else 5)
        rows.append((i, f"m{i % 4 % 3}", None if i % 97 == 0 else score, int(rng.random() < 0.4)))
    return rows, spark.createDataFrame(rows, "row_id BIGINT, model STRING, score DOUBLE, _label INT").repartition(5)


def brute_counts(rows, threshold):
    kept = [(s, y) for _, _, s, y in rows if s is not None]
    tp = sum(s >= threshold and y == 1 for s, y in kept)
    fp = sum(s >= threshold and y == 0 for s, y in kept)
    return tp, fp, sum(y == 0 for _, y in kept) - fp, sum(y == 1 for _, y in kept) - tp


def by_model(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def test_sweep_equals_definition(scores):
    rows, df = scores
    points = metrics.threshold_sweep(df, by=["model"]).collect()
    assert len(points) == 21 * 3
    for p in points:
        assert (p.tp, p.fp, p.tn, p.fn) == brute_counts(by_model(rows)[p.model], p.threshold)


def test_sweep_recall_never_rises(scores):
    _, df = scores
    recalls = [r.recall for r in metrics.threshold_sweep(df).orderBy("threshold").collect()]
    assert recalls == sorted(recalls, reverse=True)


def test_sweep_of_nothing_is_empty(scores):
    assert metrics.threshold_sweep(scores[1].limit(0)).collect() == []


def test_threshold_grid():
    assert metrics.threshold_grid()[:3] == [0.0, 0.05, 0.1] and len(metrics.threshold_grid()) == 21
    assert metrics.threshold_grid(0.07)[-1] == 1.0


def brute_auc(rows):
    pos = [s for _, _, s, y in rows if s is not None and y == 1]
    neg = [s for _, _, s, y in rows if s is not None and y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    kept = [(s, y) for _, _, s, y in rows if s is not None]
    total, out, last = sum(y for _, y in kept), 0.0, 0.0
    for s in sorted({s for s, _ in kept}, reverse=True):
        tp = sum(y for x, y in kept if x >= s)
        recall, precision = tp / total, tp / sum(x >= s for x, _ in kept)
        out, last = out + (recall - last) * precision, recall
    return out


def test_ranking_metrics_equal_definition(scores):
    rows, df = scores
    got = metrics.ranking_metrics(metrics.ranked_scores(df, ["model"]), ["model"]).collect()
    for r in got:
        assert r.roc_auc == pytest.approx(brute_auc(by_model(rows)[r.model]))
        assert r.average_precision == pytest.approx(brute_ap(by_model(rows)[r.model]))


def test_full_report_agrees_with_confusion_counts(scores):
    _, df = scores
    a = {r.model: r for r in metrics.full_report(df, ["model"]).collect()}
    b = metrics.classification_report(metrics.confusion_counts(df.where("score IS NOT NULL"), ["model"])).collect()
    for r in b:
        for name in ("n", "accuracy", "macro_f1", "weighted_recall", "precision_1"):
            assert a[r.model][name] == pytest.approx(r[name])


def test_single_class(spark):
    one = spark.createDataFrame([(0, 0.2), (0, 0.7)], "_label INT, score DOUBLE")
    r = metrics.full_report(one).first()
    assert r.roc_auc is None and r.average_precision == 0.0 and r.recall_1 == 0.0
    assert r.macro_f1 == pytest.approx((2 / 3 + 0) / 2)


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "score DOUBLE, _label INT")
    r = metrics.calibrate_threshold(df, 0.9, candidates="distinct").first()
    assert (r.threshold, r.precision, r.recall, r.achieved_target, r.evaluated_points) == (0.8, 1.0, 1.0, True, 4)
    none = metrics.calibrate_threshold(df.withColumn("_label", F.lit(0))).first()
    assert (none.threshold, none.precision, none.achieved_target) == (0.5, 0.0, False)
    with pytest.raises(ValueError):
        metrics.calibrate_threshold(df, candidates="some")


@pytest.mark.parametrize("kind", ["grid", "distinct"])
def test_calibration_is_the_best_of_its_candidates(scores, kind):
    rows, df = scores
    candidates = [i / 50 for i in range(51)] if kind == "grid" else sorted({r[2] for r in rows if r[2] is not None})
    r = metrics.calibrate_threshold(df, 0.8, 50, candidates=kind).first()
    assert r.evaluated_points == len(candidates) and r.threshold in candidates
    points = {}
    for t in candidates:
        tp, fp, _, fn = brute_counts(rows, t)
        points[t] = (tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn))
    assert (r.precision, r.recall) == pytest.approx(points[r.threshold]) and r.recall >= 0.8
    allowed = [p for p, recall in points.values() if recall >= 0.8]
    assert r.precision == pytest.approx(max(allowed))
    assert not any(t < r.threshold and recall >= 0.8 and p >= r.precision + 1e-12 for t, (p, recall) in points.items())


def test_two_valued_report_equals_the_curves(spark):
    rows = [(1.0, 1)] * 7 + [(1.0, 0)] * 2 + [(0.0, 1)] * 3 + [(0.0, 0)] * 8
    df = spark.createDataFrame(rows, "score DOUBLE, _label INT")
    both = metrics.full_report(df).first(), metrics.two_valued_report(metrics.confusion_counts(df)).first()
    for name in ("roc_auc", "average_precision", "pr_auc", "macro_f1", "n"):
        assert both[0][name] == pytest.approx(both[1][name]), name


def test_histogram_holds_every_row(scores):
    rows, df = scores
    total = metrics.score_histogram(df).agg(F.sum("n_rows")).first()[0]
    assert total == sum(r[2] is not None for r in rows)
    flat = metrics.score_histogram(df.withColumn("score", F.lit(0.5))).where("n_rows > 0").collect()
    assert {r.bin for r in flat} == {10}


def test_running_totals_with_null_keys(spark):
    rows = [(None if i % 5 == 0 else i % 2, i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k INT, b INT, v BIGINT").withColumn("one", F.lit(1).cast("bigint"))
    got = {(r.k, r.v): r for r in running_totals(df, ["k"], [F.col("b").desc(), F.col("v")], ["one"]).collect()}
    assert len(got) == 200
    for k, b, v in rows:
        ahead = sum(1 for k2, b2, v2 in rows if k2 == k and (-b2, v2) < (-b, v))
        assert got[(k, v)].one_before == ahead
        assert got[(k, v)].one_total == sum(1 for r in rows if r[0] == k)


def test_ranks_are_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    for group in rank_in_order(df, ["k"], [F.col("d")]).groupBy("k").agg(F.sort_array(F.collect_list("_rank")).alias("r")).collect():
        assert group.r == list(range(len(group.r)))


def test_ranges_stay_bounded_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(prefix, "range_count", lambda rows, least: max(1, -(-rows // 200)))
    for n in (1000, 8000):
        placed = prefix.in_ranges(spark.range(n).withColumn("k", F.lit(0)), ["k"], [F.col("id")])
        sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
        assert sum(sizes) == n and max(sizes) < 600 and len(sizes) >= n // 400
    assert prefix.range_count.__name__ == "<lambda>"


def test_number_of_ranges():
    assert prefix.range_count(10, 8) == 8
    assert prefix.range_count(10**9, 8) * prefix.MAX_RANGE_ROWS >= 10**9
    assert prefix.range_count(0, 0) == 1


def test_attach_group_values_with_hot_groups(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 2500)).alias("key")
    )
    groups = rows.groupBy("key").agg(F.count("*").alias("size")).withColumn("value", F.concat(F.lit("v-"), "key"))
    out = attach_group_values(rows, groups.where("key <> 'g7'"), "key", "size", ["value"], spread_by="row_id")
    assert out.columns == ["row_id", "key", "value"]
    got = out.collect()
    assert len(got) == 6000
    assert all(r.value == (None if r.key == "g7" else f"v-{r.key}") for r in got)


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(9)
    rows = []
    for i in range(4000):
        key = "big" if i % 3 == 0 else f"g{int(rng.paretovariate(0.8)) % 700}"
        rows.append((i, key, int(hash(key) % 3 == 0 if key != "big" else i % 2)))
    return spark.createDataFrame(rows, "row_id BIGINT, group_key STRING, _label INT")


def test_split_is_disjoint_stratified_and_complete(grouped):
    table = splits.stratified_group_split(grouped)
    assert table.count() == 4000 and splits.leaking_groups(table).isEmpty()
    groups = splits.split_groups(grouped).groupBy("strat_label", "split").count().collect()
    per = {(r.strat_label, r.split): r["count"] for r in groups}
    for s in (0, 1):
        n = sum(v for (a, _), v in per.items() if a == s)
        for name, share in zip(splits.SPLITS, splits.RATIOS):
            assert abs(per.get((s, name), 0) - share * n) <= 1.5


def test_split_is_repeatable_and_seeded(grouped):
    a = {(r.row_id, r.split) for r in splits.stratified_group_split(grouped, seed=1).collect()}
    b = {(r.row_id, r.split) for r in splits.stratified_group_split(grouped.repartition(7), seed=1).collect()}
    c = {(r.row_id, r.split) for r in splits.stratified_group_split(grouped, seed=2).collect()}
    assert a == b and a != c


def test_bad_ratios_and_unknown_split(grouped):
    with pytest.raises(ValueError):
        splits.split_groups(grouped, (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.select_split(grouped, splits.stratified_group_split(grouped), "final")


def after(histogram, moves):
    """Rows per split once the moves are made."""
    rows = Counter({s: 0 for s in splits.SPLITS})
    for (split, size), n in histogram.items():
        ends = moves.get((split, size), {split: n})
        assert sum(ends.values()) == n and all(k >= 0 for k in ends.values())
        for end, k in ends.items():
            rows[end] += size * k
    return dict(rows)


# Worked by hand: the split furthest above its target gives its smallest group to the one furthest below.
WORKED = [
    ({("train", 1): 3, ("train", 5): 1}, {"train": 6, "val": 1, "test": 1}, {"train": 6, "val": 1, "test": 1}),
    ({("train", 4): 2}, {"train": 4, "val": 4, "test": 0}, {"train": 4, "val": 4, "test": 0}),
    ({("train", 2): 4, ("val", 2): 4}, {"train": 4, "val": 4, "test": 8}, {"train": 4, "val": 4, "test": 8}),
    ({("test", 3): 6}, {"train": 6, "val": 6, "test": 6}, {"train": 6, "val": 6, "test": 6}),
    ({("train", 10): 1}, {"train": 2, "val": 4, "test": 4}, {"train": 0, "val": 10, "test": 0}),
    ({("train", 1): 4}, {"train": 4, "val": 0, "test": 0}, {"train": 4, "val": 0, "test": 0}),
]


@pytest.mark.parametrize("histogram,targets,rows", WORKED)
def test_rebalance_plan_of_worked_examples(histogram, targets, rows):
    assert after(histogram, splits.plan_moves(histogram, targets, max_moves=6 if 10 not in [s for _, s in histogram] else 1)) == rows


@pytest.mark.parametrize("seed", range(40))
def test_moves_in_one_go_equal_the_same_number_of_single_moves(seed):
    """A plan of k moves is k plans of one move each, made one after the other."""
    rng = random.Random(seed)
    histogram = Counter((rng.choice(splits.SPLITS), rng.choice([1, 1, 2, 3, 8, 20])) for _ in range(rng.randrange(5, 90)))
    total = sum(size * n for (_, size), n in histogram.items())
    targets = {"train": total * rng.randrange(8) // 10, "val": total * rng.randrange(3) // 10}
    targets["test"] = max(0, total - sum(targets.values()))
    limit = rng.randrange(1, 60)
    # Groups that have moved count as their new split's own, which changes no row count.
    state = Counter(histogram)
    for _ in range(limit):
        step = splits.plan_moves(dict(state), targets, max_moves=1)
        for (split, size), ends in step.items():
            del state[split, size]
            for end, n in ends.items():
                state[end, size] += n
        state = +state
    rows = Counter({s: 0 for s in splits.SPLITS})
    for (split, size), n in state.items():
        rows[split] += size * n
    assert after(histogram, splits.plan_moves(dict(histogram), targets, max_moves=limit)) == dict(rows)


def test_rebalance_reaches_targets_and_keeps_groups_whole(grouped):
    targets = {"train": 2500, "val": 500, "test": 1000}
    table = splits.stratified_group_split(grouped, targets=targets)
    assert table.count() == 4000 and splits.leaking_groups(table).isEmpty()
    got = {r["split"]: r["count"] for r in table.groupBy("split").count().collect()}
    before = {r["split"]: r["count"] for r in splits.stratified_group_split(grouped).groupBy("split").count().collect()}
    off = lambda counts: sum(abs(counts.get(s, 0) - t) for s, t in targets.items())
    assert off(got) <= off(before)


def test_rebalance_many_equal_groups_is_fast():
    moves = splits.plan_moves({("train", 1): 10**9, ("val", 1): 10**9}, {"train": 10, "val": 10, "test": 2 * 10**9 - 20})
    assert moves[("train", 1)]["test"] + moves[("val", 1)]["test"] == 2 * 10**9 - 20


def test_assert_disjoint(spark, grouped):
    table = splits.stratified_group_split(grouped)
    splits.assert_disjoint(grouped, table)
    leaking = table.withColumn("split", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(ValueError):
        splits.assert_disjoint(grouped, leaking)
    one_class = grouped.withColumn("_label", F.lit(0))
    with pytest.raises(ValueError):
        splits.assert_disjoint(one_class, table)


def test_kfold_is_balanced(grouped):
    folds = splits.stratified_kfold(grouped, 5).groupBy("_label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["_label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def rule_features(spark, rows):
    names = rules.RULE_FLAGS + rules.RULE_NUMERICS
    full = [tuple(float(r.get(n, 0)) for n in names) + (r.get("image", ""), r["y"], i) for i, r in enumerate(rows)]
    schema = ", ".join(f"{n} DOUBLE" for n in names) + ", source_image_base STRING, _label INT, row_id BIGINT"
    return spark.createDataFrame(full, schema)


def test_rule_mining_support_limit(spark):
    two = rule_features(spark, [{"has_curl": 1, "y": 1}] * 2 + [{"y": 0}] * 5)
    three = rule_features(spark, [{"has_curl": 1, "y": 1, "image": "a"}] * 3 + [{"y": 0, "image": "b"}] * 5)
    assert rules.mine_boolean_rules(two).count() == 0
    assert [r.feature for r in rules.mine_boolean_rules(three).collect()] == ["has_curl"]
    assert [r.category for r in rules.mine_category_rules(three).collect()] == ["a"]


def test_numeric_rule_without_benign_rows(spark):
    only = rule_features(spark, [{"cmd_length": v, "y": 1} for v in (1, 2, 3, 10)])
    mined = {r.feature: r.threshold for r in rules.mine_numeric_rules(only).collect()}
    assert mined["cmd_length"] == pytest.approx(4.75) and set(mined) == set(rules.RULE_NUMERICS)


def test_rules_survive_a_round_trip(spark):
    df = rule_features(spark, [{"has_curl": 1, "y": 1, "image": "a", "cmd_length": 9}] * 4 + [{"y": 0, "image": "b", "cmd_length": 2}] * 8)
    mined, values = rules.mine_rules(df)
    path = shared_dir(spark) + "/cmdprism/test-rules"
    tables.write_rules(rules.rules_with_categories(mined, values), path)
    saved = tables.read_rules(spark, path)
    fired = rules.apply_rules(df, saved, rules.categories_of(saved)).orderBy("row_id").collect()
    assert fired[0].fired_rules == ["has_curl", "high_cmd_length", "hot_source_image_base"]
    assert [r.rule_label for r in fired] == [1] * 4 + [0] * 8


EDGE_LINES = [
    "", "   ", "{bad", "[1]", "{}", '{"CommandLine": "a", "L": "MALICIOUS"}', '{"CommandLine": null, "L": " benign "}',
    '{"L": "1"}', '{"L": 2}', '{"L": true}', '{"L": 1.0, "CommandLine": 5}', '{"N": {"predicted_label": "benign"}}',
    '{"L": null, "N": {"predicted_label": "malicious"}}', '{"L": 0, "L": 1}', '{"L": 0, "prompt": "é\\u00e8"}', '{"L": 0} x',
    '{"L": 0}{"L": 1}', '{"L": 0}]', "5",
]


def test_read_events_edge_lines(spark, tmp_path):
    names = {'"L"': f'"{events.VERDICT_FIELD}.predicted_label"', '"N"': f'"{events.VERDICT_FIELD}"'}
    lines = []
    for line in EDGE_LINES:
        for short, full in names.items():
            line = line.replace(short, full)
        lines.append(line)
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = events.read_events(spark, str(tmp_path))
    assert sorted(r.raw for r in bad.collect()) == sorted(lines[i] for i in (2, 3, 15, 16, 17, 18))
    checked = ingest.check_events(events.with_file_row_id(good)).orderBy("row_id").collect()
    assert [r.row_id for r in checked] == list(range(11))
    assert [r.reject_reason for r in checked] == [
        "missing_label", None, "invalid_label", None, "invalid_label", None, "non_text_field", None, None, None, None,
    ]
    assert [r["_label"] for r in checked if r.reject_reason is None] == [1, 1, 1, 0, 1, 1, 0]
    assert checked[10].prompt == "éè"


@pytest.mark.parametrize("block", ["1k", "128m"])
def test_rejected_lines_carry_their_line_number(spark, tmp_path, block):
    """Blank lines count, whether a file is read in one block or in many."""
    want = {}
    for name, count in (("b.jsonl", 7), ("a.jsonl", 900)):
        lines = []
        for i in range(count):
            lines.append(["", "   ", '{"L": 1}', f"broken {name} {i}", '{"ProcessId": "x"}'][(i * i + i // 3) % 5])
            if lines[-1].startswith("broken"):
                want[lines[-1]] = i + 1
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        _, bad = events.read_events(spark, str(tmp_path))
        assert {r["raw"]: r["line_number"] for r in bad.collect()} == want and len(want) > 100
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_file_row_ids_follow_files_and_lines(spark, tmp_path):
    for name, count in (("b.jsonl", 3), ("a.jsonl", 400), ("c.jsonl", 50)):
        (tmp_path / name).write_text("".join(f'{{"ProcessId": "{name}-{i}"}}\n' for i in range(count)))
    good, _ = events.read_events(spark, str(tmp_path))
    ids = [r.ProcessId for r in events.with_file_row_id(good).orderBy("row_id").collect()]
    assert ids == [f"{n}-{i}" for n, c in (("a.jsonl", 400), ("b.jsonl", 3), ("c.jsonl", 50)) for i in range(c)]


def test_json_folder_skips_broken_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    (tmp_path / "two.json").write_text('{"a": ')
    rows = events.read_json_folder(spark, str(tmp_path), "a INT, b STRING").collect()
    assert [(r.key, r.a, r.b) for r in rows] == [("one", 1, "x")]


def test_record_reader_fails_on_broken_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception):
        events.read_jsonl(spark, str(tmp_path), "a INT").collect()
    with pytest.raises(ValueError):
        events.require_rows(spark.createDataFrame([], "a INT"), "records")


def test_label_guard_and_threshold_default(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,)], "a INT").write.parquet(path)
    with pytest.raises(ValueError):
        tables.read_processed(spark, path)
    with pytest.raises(ValueError):
        ingest.require_labeled(spark.createDataFrame([(None,)], "_label INT"))
    spark.createDataFrame([(0.3,)], "threshold DOUBLE").write.parquet(path + "2")
    assert tables.read_threshold(spark, None) == 0.5 and tables.read_threshold(spark, path + "2") == 0.3


def test_missing_prediction_is_an_error(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id BIGINT")
    outside = spark.createDataFrame([(1, 0, "benign", None), (1, 1, "malicious", "0.4")], "row_id BIGINT, seq INT, label STRING, confidence STRING")
    with pytest.raises(ValueError):
        lookups.attach_predictions(rows, outside, "seq")
    only = lookups.attach_predictions(rows.where("row_id = 1"), outside, "seq")
    number = lookups.prediction_to_prob(F.col("label"), F.col("confidence"), F.lit(True))
    assert only.select(number).first()[0] == 0.4
    assert only.select(lookups.prediction_to_prob(F.col("label"), F.col("confidence"))).first()[0] == 1.0


def test_costs_with_zero_latency_keep_the_old_price(spark):
    rows = spark.createDataFrame([("GBDT", 0.0), ("rf", 0.001), ("claude", 1.5), ("new", 0.002)], "model STRING, latency_seconds DOUBLE")
    old = spark.createDataFrame([("gbdt", 7.0, "was")], "model STRING, per_prediction_usd DOUBLE, notes STRING")
    got = {r.model: r for r in costs.cost_per_prediction(rows, old).collect()}
    assert got["gbdt"].per_prediction_usd == 7.0 and got["gbdt"].notes.startswith("was | AWS m5.large")
    assert got["rf"].per_prediction_usd == pytest.approx(0.096 / (3600 / 0.001 * 0.7))
    assert got["claude"].per_prediction_usd == 0.0018 and got["new"].per_prediction_usd == pytest.approx(0.096 / (3600 / 0.002 * 0.7))


def event(spark):
    rows = [(42, "[t] | PID=1", "cmd.exe /c whoami", "C:\\cmd.exe", "discovery", 1, ("Suspicious", "discovery", "high"))]
    schema = (
        "row_id BIGINT, prompt STRING, CommandLine STRING, SourceImage STRING, _attack_technique STRING, _label INT, "
        "verdict_json STRUCT<reason: STRING, attack_technique: STRING, confidence: STRING>"
    )
    return spark.createDataFrame(rows, schema)


def test_instruction_record(spark):
    import json

    r = corpus.instruction_records(event(spark), "train").first()
    assert (r.row_id, r.split, r.output.label, r.output.attack_technique) == (42, "train", "malicious", "discovery")
    shown = json.loads(r.input_text)
    assert list(shown) == ["SourceImage", "CommandLine", "_attack_technique", "generated_prompt"]
    assert shown["generated_prompt"] == "[unknown] | Host=unknown | User=unknown | Image=C:\\cmd.exe | Parent=unknown | Cmd=cmd.exe /c whoami"
    assert json.loads(r.output_text) == {"label": "malicious", "explanation": "Suspicious", "attack_technique": "discovery", "confidence": "high"}
    assert r.formatted_prompt.endswith("\n\nContext:\n" + r.input_text)


def test_supervised_pair_fallbacks(spark):
    rows = [("classify", {"foo": "bar"}, {"label": "benign"}, None, None), ("a", {}, {}, "p", "r")]
    schema = "instruction STRING, input MAP<STRING, STRING>, output MAP<STRING, STRING>, formatted_prompt STRING, formatted_response STRING"
    first, second = corpus.supervised_pairs(spark.createDataFrame(rows, schema)).collect()
    assert first.prompt == 'classify\n\nContext:\n{"foo":"bar"}' and first.response == '{"label":"benign"}'
    assert (second.prompt, second.response) == ("p", "r")


def test_export_without_records_is_an_error(spark):
    empty = spark.createDataFrame([], "row_id BIGINT, split STRING")
    with pytest.raises(ValueError):
        corpus.export_corpus(event(spark), empty, shared_dir(spark) + "/cmdprism/test-empty-corpus")


@pytest.mark.parametrize("one_range", [0, 1 << 16])
def test_keyed_ranges_give_the_same_totals(spark, monkeypatch, one_range):
    """Rows dealt by quantiles of a key, in many ranges or in one, against a plain sum."""
    monkeypatch.setattr(prefix, "ONE_RANGE_ROWS", one_range)
    rng = random.Random(5)
    scores = [*rng.sample(range(-500, 500), 300), float("nan"), float("inf"), float("-inf")]
    rows = [(k, float(s), rng.randint(0, 5)) for k in ("a", "b", None) for s in scores]
    df = spark.createDataFrame(rows, "k string, s double, n long")
    got = {(r.k, str(r.s)): (r.n_before, r.n_total) for r in running_totals(df, ["k"], [F.col("s").desc()], ["n"], -F.col("s")).collect()}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] == r[1], -r[1] if r[1] == r[1] else 0))
        before = 0
        for _, s, n in own:
            assert got[k, str(s)] == (before, sum(r[2] for r in own))
            before += n


def test_digest_keys_follow_the_digests(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    rows = df.select("d", prefix.digest_key(F.col("d")).alias("k")).orderBy("d").collect()
    keys = [r.k for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == 500


def test_an_exported_corpus_is_packed_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILE_RECORDS", 2)
    df = spark.range(7).select(F.col("id").alias("row_id"), F.lit("cmd.exe /c whoami").alias("CommandLine"), (F.col("id") % 2).cast("int").alias("_label"))
    splits = df.select("row_id", F.when(F.col("row_id") < 5, "train").otherwise("test").alias("split"))
    assert corpus.export_corpus(df, splits, f"{tmp_path}/out") == {"train": 5, "test": 2}
    files = [f.name for f in tmp_path.glob("out/split=train/part-*")]
    assert len(files) >= 3 and all(f.endswith(".json.gz") for f in files)
    saved = spark.read.json(f"{tmp_path}/out")
    want = corpus.instruction_records(df.join(splits, "row_id"), F.col("split")).select("row_id", "split", "formatted_prompt", "formatted_response")
    assert sorted(saved.select(*want.columns).collect()) == sorted(want.collect()) and saved.count() == 7

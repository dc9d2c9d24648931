"""Trees against plain loops: growth, waves, tasks, categories, tuning, Shapley values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cmdprism.operators import growth, models, trees
from cmdprism.operators.attribution import Attribution
from cmdprism.operators.growth import UNIT, Layout, TreeParams

NUMBERS = ("n0", "n1", "n2")
LAYOUT = Layout(NUMBERS, ((0.0, 1.0), (0.0, 1.0, 2.0, 3.0, 4.0), tuple(float(v) for v in range(8))), ("c0", "c1"), (7, 40))


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 5, n), rng.integers(0, 8, n), rng.integers(0, 7, n), rng.integers(0, 40, n)])
    z = 2.0 * x[:, 0] - 0.5 * x[:, 1] + (x[:, 3] % 2) * 1.5 + (x[:, 4] % 3 == 0) * 1.2 - 0.8
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return x.astype(np.int32), y


def binned(spark, x, y, fold=None):
    rows = [(i, i * 31, int(f), int(label), *map(int, v)) for i, (v, label, f) in enumerate(zip(x, y, np.zeros(len(y)) if fold is None else fold))]
    schema = "row long, key long, fold int, label int, " + ", ".join(f"x{i} int" for i in range(x.shape[1]))
    return spark.createDataFrame(rows, schema)


class Plain:
    """Boosting by loops over rows and all splits: leaf-wise, or by level where there is no limit on leaves."""

    def __init__(self, x, y, p, layout, train, weights=(1.0, 1.0)):
        self.x, self.p, self.layout, self.rows = x, p, layout, [i for i in range(len(y)) if train[i]]
        zero, one = (weights[c] * sum(1 for i in self.rows if y[i] == c) for c in (0, 1))
        self.margin = [math.log(one / zero)] * len(y)
        self.sizes, self.losses = [], []
        for t in range(p.n_estimators):
            prob = [1.0 / (1.0 + float(np.exp(-m))) for m in self.margin]
            w = [weights[c] for c in y]
            self.g = [float(np.rint((a - b) * c * UNIT)) for a, b, c in zip(prob, y, w)]
            self.h = [float(np.rint(a * (1 - a) * c * UNIT)) for a, c in zip(prob, w)]
            self.seen = [bool(s) for s in growth.sampled(p, t, np.arange(len(y)) * 31)]
            self.round(list(range(len(y))))
            self.losses.append(-sum(w[i] * math.log(1 / (1 + math.exp(-self.margin[i] if y[i] else self.margin[i]))) for i in self.rows))

    def totals(self, rows):
        used = [i for i in rows if i in self.train and self.seen[i]]
        return sum(self.g[i] for i in used) / UNIT, sum(self.h[i] for i in used) / UNIT, len(used)

    def gain(self, left, right, l2):
        (gl, hl, nl), (gr, hr, nr) = self.totals(left), self.totals(right)
        p = self.p
        if min(nl, nr) < max(p.min_child_samples, 1) or min(hl, hr) < p.min_child_weight:
            return None
        side = lambda g, h, l: g * g / (h + l) if h + l > 0 else 0.0
        return side(gl, hl, l2) + side(gl + gr - gl, hl + hr - hl, l2) - side(gl + gr, hl + hr, p.reg_lambda)

    def best(self, rows):
        found = None

        def offer(goes, l2):
            nonlocal found
            left = [i for i in rows if goes(self.x[i])]
            right = [i for i in rows if not goes(self.x[i])]
            gain = self.gain(left, right, l2)
            if gain is not None and gain > 1e-10 and (found is None or gain > found[0] + 1e-12):
                found = (gain, left, right)

        p, wide = self.p, len(self.layout.numbers)
        for f in range(wide):
            for cut in range(len(self.layout.cuts[f]) - 1):
                offer(lambda v, f=f, cut=cut: v[f] <= cut, p.reg_lambda)
        for k in range(len(self.layout.sizes)):
            f = wide + k
            codes = sorted({int(self.x[i][f]) for i in rows if i in self.train and self.seen[i]})
            if not p.native_categories:
                for c in codes:
                    offer(lambda v, f=f, c=c: v[f] == c, p.reg_lambda)
                continue

            def ratio(c, f=f):
                g, h, _ = self.totals([i for i in rows if self.x[i][f] == c])
                return g / (h + p.cat_smooth)

            for sign in (1, -1):
                order = sorted(codes, key=lambda c: (sign * ratio(c), c))
                for n in range(1, min(len(order), p.max_cat_threshold) + 1):
                    offer(lambda v, f=f, own=frozenset(order[:n]): int(v[f]) in own, p.reg_lambda + p.cat_l2)
        return found

    def round(self, rows):
        self.train = set(self.rows)
        leaves = [(0, rows, self.best(rows))]
        while True:
            open_ = [k for k, (depth, _, b) in enumerate(leaves) if b and (self.p.max_depth is None or depth < self.p.max_depth)]
            if not open_ or self.p.num_leaves is not None and len(leaves) >= self.p.num_leaves:
                break
            k = max(open_, key=lambda k: leaves[k][2][0])
            depth, _, (_, left, right) = leaves.pop(k)
            leaves += [(depth + 1, left, self.best(left)), (depth + 1, right, self.best(right))]
        self.sizes.append(len(leaves))
        for _, own, _ in leaves:
            g, h, _ = self.totals(own)
            for i in own:
                self.margin[i] += -self.p.learning_rate * g / (h + self.p.reg_lambda) if h + self.p.reg_lambda > 0 else 0.0


LEAFWISE = TreeParams(n_estimators=6, learning_rate=0.3, num_leaves=6, min_child_samples=3, colsample_bytree=1.0, max_cat_threshold=5, reg_lambda=0.5)
BY_LEVEL = TreeParams(
    n_estimators=5, learning_rate=0.3, num_leaves=None, max_depth=3, reg_lambda=1.0, min_child_weight=0.3, min_child_samples=1,
    colsample_bytree=1.0, native_categories=False, subsample=0.7, subsample_freq=1,
)
FOREST = TreeParams(n_estimators=7, num_leaves=None, forest=True, native_categories=False, class_weight="balanced_subsample")


@pytest.mark.parametrize("p", [LEAFWISE, BY_LEVEL], ids=["leafwise", "by_level"])
@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.7, 1.9)])
def test_boosting_equals_plain_loops(p, weights):
    x, y = table(120)
    train = np.arange(120) % 5 != 0
    plain = Plain(x, y, p, LAYOUT, train, weights)
    cells = growth.Cells.of(x, y, train)
    _, made, margin = growth.boost(cells, np.arange(120) * 31, weights, LAYOUT, p)
    assert np.allclose(margin[cells.of_row], plain.margin, atol=1e-9)
    assert [sum(v < 0 for v in t["left"]) for t in made] == plain.sizes
    if p is LEAFWISE:
        assert plain.losses == sorted(plain.losses, reverse=True) and max(plain.sizes) <= p.num_leaves


def sorted_nodes(made):
    return made.sort_values(["tree", "value", "cover", "column", "cut"], ignore_index=True)[["tree", "column", "cut", "value", "cover"]]


@pytest.mark.parametrize("p", [LEAFWISE, BY_LEVEL, FOREST], ids=["leafwise", "by_level", "forest"])
@pytest.mark.parametrize("category_rows", [1 << 16, 8])
def test_waves_and_tasks_grow_the_same_trees(spark, monkeypatch, p, category_rows):
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    monkeypatch.setattr(trees, "CATEGORY_ROWS", category_rows)
    x, y = table(300, 1)
    rows = binned(spark, x, y).repartition(3)
    if p is not FOREST:
        p = TreeParams(**{**p.__dict__, "n_estimators": 3})
    base, small = trees.fit(rows, LAYOUT, p)
    again, large = trees.fit(rows, LAYOUT, p, task_rows=60)
    assert base == again and len(small) == len(large)
    pd.testing.assert_frame_equal(sorted_nodes(small), sorted_nodes(large), check_dtype=False)


def repeated(n, seed):
    """Rows of which many are equal, with labels that the columns don't settle."""
    x, y = table(n, seed)
    x[:, 1:3] %= 2
    x[:, 3:] %= 3
    return x, y


@pytest.mark.parametrize("p", [LEAFWISE, BY_LEVEL, FOREST], ids=["leafwise", "by_level", "forest"])
def test_counted_rows_grow_the_same_trees(spark, monkeypatch, p):
    """A table of more rows than a task may hold, but fewer different ones, is counted and needs no wave."""

    def no_waves(*_):
        raise AssertionError("grown in waves")

    monkeypatch.setattr(trees, "grow_waves", no_waves)
    monkeypatch.setattr(trees, "CHUNK", 3)
    monkeypatch.setattr(trees, "HELD_CELLS", 20)
    x, y = repeated(600, 8)
    assert 60 < len(np.unique(np.column_stack([x, y]), axis=0)) <= 200
    rows = binned(spark, x, y).repartition(5)
    base, small = trees.fit(rows, LAYOUT, p)
    again, counted = trees.fit(rows, LAYOUT, p, task_rows=200)
    assert base == again and len(small) == len(counted) > 20
    pd.testing.assert_frame_equal(sorted_nodes(small), sorted_nodes(counted), check_dtype=False)


@pytest.mark.parametrize("p", [LEAFWISE, BY_LEVEL, FOREST], ids=["leafwise", "by_level", "forest"])
def test_counted_rows_are_tuned_alike(spark, monkeypatch, p):
    monkeypatch.setattr(trees, "CHUNK", 3)
    monkeypatch.setattr(trees, "grow_waves", None)
    x, y = repeated(900, 9)
    rows = binned(spark, x, y, np.arange(900) % 2)
    points = [TreeParams(**{**p.__dict__, "n_estimators": n, "max_depth": d}) for n, d in ((4, 2), (7, 3))]
    found = [
        {(r["point"], r["fold"], r["label"], r["prediction"]): r["n"] for r in trees.held_predictions(rows, LAYOUT, points, 2, bound).collect()}
        for bound in (1 << 18, 400)
    ]
    assert found[0] == found[1] and sum(found[0].values()) == 2 * 900


def test_a_forest_has_pure_leaves(spark):
    """Without a limit on depth every leaf is pure unless its rows can't be told apart."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, 400), rng.integers(0, 5, 400), rng.integers(0, 8, 400), rng.integers(0, 7, 400), rng.integers(0, 40, 400)])
    x = np.unique(x.astype(np.int32), axis=0)
    y = rng.integers(0, 2, len(x))
    for bound in (1 << 18, 50):
        _, made = trees.fit(binned(spark, x, y), LAYOUT, TreeParams(n_estimators=4, num_leaves=None, forest=True, native_categories=False), bound)
        leaves = made[made["left"] < 0]
        assert set(leaves["value"]) == {0.0, 1.0} and len(leaves) > 4 * 50


def test_a_category_of_many_values_needs_no_bins(spark):
    """100,000 values, of which the even ones are bad."""
    rows = spark.range(200_000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("v"), (F.col("id") % 100_000).cast("string")).alias("SourceImage"),
        F.lit("run").alias("CommandLine"), (F.col("id") % 2).cast("int").alias("_label"),
    )
    from cmdprism.functions.features import build_features

    features = build_features(rows)
    model = models.train_gbdt(features, {"n_estimators": 3, "colsample_bytree": 1.0, "min_child_samples": 1, "cat_smooth": 0.0})
    nodes = model.trees.nodes
    assert (nodes["column"] == "source_image_base").any()
    assert nodes["values"].map(len).max() == 32 and len({v for own in nodes["values"] for v in own}) > 32
    best = model.score(features).where(F.col("prob_gbdt") > 0.5001).agg(F.min("_label"), F.count("*")).first()
    assert best[0] == 1 and best[1] > 0


def test_scores_of_raw_rows_are_those_of_binned_rows(spark):
    x, y = table(200, 4)
    _, made = trees.fit(binned(spark, x, y), LAYOUT, LEAFWISE)
    tables = {c: spark.createDataFrame([(f"{c}-{i}", float(i)) for i in range(s)], "value string, index double") for c, s in zip(LAYOUT.categories, LAYOUT.sizes)}
    model = trees.model_of(0.25, made, LAYOUT, LEAFWISE, tables)
    cells = growth.Cells.of(x, y, np.ones(200, bool))
    base, _, margin = growth.boost(cells, np.arange(200) * 31, (1.0, 1.0), LAYOUT, LEAFWISE)
    raw = spark.createDataFrame(
        [(i, *map(float, v[:3]), f"c0-{v[3]}", f"c1-{v[4]}") for i, v in enumerate(x.tolist())], "row long, n0 double, n1 double, n2 double, c0 string, c1 string"
    )
    got = {r["row"]: r["p"] for r in raw.select("row", model.probability().alias("p")).collect()}
    want = 1 / (1 + np.exp(-(margin[cells.of_row] - base + 0.25)))
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-12)
    unseen = raw.limit(1).select(F.lit(0.0).alias("n0"), F.lit(None).cast("double").alias("n1"), F.lit(9.0).alias("n2"), F.lit("new").alias("c0"), F.lit(None).cast("string").alias("c1"))
    assert 0 < unseen.select(model.probability()).first()[0] < 1


def plain_macro_f1(label, predicted):
    scores = []
    for c in (0, 1):
        tp = sum(a == b == c for a, b in zip(label, predicted))
        wrong = sum((a == c) != (b == c) for a, b in zip(label, predicted))
        scores.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    return sum(scores) / 2


@pytest.mark.parametrize("task_rows", [1 << 18, 20])
def test_tuning_equals_a_plain_trainer(spark, task_rows):
    """Macro F1 of every point and fold, in tasks and in waves."""
    x, y = table(90, 5)
    fold = np.arange(90) % 3
    points = [TreeParams(**{**LEAFWISE.__dict__, "n_estimators": 3, "num_leaves": n}) for n in (3, 5)]
    hits = trees.held_predictions(binned(spark, x, y, fold), LAYOUT, points, 3, task_rows)
    got = {(r["point"], r["fold"]): r for r in models.macro_f1(hits, ["point", "fold"]).collect()}
    for k, p in enumerate(points):
        for f in range(3):
            plain = Plain(x, y, p, LAYOUT, fold != f)
            held = np.flatnonzero(fold == f)
            assert got[k, f]["macro_f1"] == pytest.approx(plain_macro_f1(y[held], [int(plain.margin[i] > 0) for i in held]))
            assert got[k, f]["n"] == 30 and got[k, f]["positives"] == y[held].sum()


def test_forest_points_share_their_trees(spark):
    """A smaller forest is the first part of a larger one, and a depth limit cuts the same trees: equal to forests of their own."""
    x, y = table(150, 6)
    fold = np.arange(150) % 2
    points = [TreeParams(**{**FOREST.__dict__, "n_estimators": n, "max_depth": d}) for d in (None, 2) for n in (3, 30)]
    rows = binned(spark, x, y, fold)
    shared = {(r["point"], r["fold"], r["label"], r["prediction"]): r["n"] for r in trees.held_predictions(rows, LAYOUT, points, 2).collect()}
    for k, p in enumerate(points):
        for f in range(2):
            _, made = trees.fit(rows.where(F.col("fold") != f), LAYOUT, p)
            alone = trees.binned_shares(rows.where(F.col("fold") == f), LAYOUT, made, p.n_estimators)
            for r in alone.groupBy("label", (F.col("share") > 0.5).cast("int").alias("prediction")).count().collect():
                assert shared[k, f, r["label"], r["prediction"]] == r["count"]


def expectation(nodes, features, node, row, known):
    """Mean output of one tree where only the features in ``known`` are known."""
    at = nodes[node]
    if at["left"] < 0:
        return at["value"]
    sides = [expectation(nodes, features, at[s], row, known) for s in ("left", "right")]
    key = features[node]
    if key in known:
        value = row[at["column"]]
        goes = value in at["values"] if isinstance(value, str) else value <= at["threshold"]
        return sides[0] if goes else sides[1]
    weights = [nodes[at[s]]["cover"] for s in ("left", "right")]
    return (sides[0] * weights[0] + sides[1] * weights[1]) / sum(weights)


@pytest.mark.parametrize("p", [LEAFWISE, BY_LEVEL, TreeParams(**{**FOREST.__dict__, "max_depth": 3})], ids=["leafwise", "by_level", "forest"])
def test_shapley_values_equal_the_sum_over_all_subsets(spark, p):
    x, y = table(150, 7)
    base, made = trees.fit(binned(spark, x, y), LAYOUT, p)
    tables = {c: spark.createDataFrame([(f"v{i}", float(i)) for i in range(s)], "value string, index double") for c, s in zip(LAYOUT.categories, LAYOUT.sizes)}
    model = trees.model_of(base, made, LAYOUT, p, tables)
    one_hot = not p.native_categories
    found = Attribution(model, one_hot)
    walker = model.walker
    some = x[:25]
    values = some[:, :3].astype(float)
    codes = np.column_stack([[walker.codes[k].get(f"v{c}", (1 << 32) - 1) for c in some[:, 3 + k]] for k in range(2)])
    impacts = found.impacts("shapley", values, codes)
    want = np.zeros_like(impacts)
    for _, tree in model.nodes.groupby("tree"):
        nodes = tree.sort_values("node").to_dict("records")
        names = [None if n["left"] < 0 else (n["column"], n["values"][0] if one_hot and len(n["values"]) else None) for n in nodes]
        used = sorted({n for n in names if n}, key=str)
        for r, v in enumerate(some):
            row = {"n0": float(v[0]), "n1": float(v[1]), "n2": float(v[2]), "c0": f"v{v[3]}", "c1": f"v{v[4]}"}
            for i in used:
                others = [u for u in used if u != i]
                for size in range(len(others) + 1):
                    weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(used))
                    for subset in itertools.combinations(others, size):
                        change = expectation(nodes, names, 0, row, {*subset, i}) - expectation(nodes, names, 0, row, set(subset))
                        want[r, found.features.index(i)] += weight * change * found.scale
    assert np.allclose(impacts, want, atol=1e-9)
    for method in ("shapley", "path"):
        total = found.impacts(method, values, codes).sum(axis=1) + found.base
        assert np.allclose(total, walker.margin(values, codes), atol=1e-9)


def test_bins_are_values_or_quantiles(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("few"), (F.col("id") * 0.5).alias("many"), F.lit(1.0).alias("one"))
    layout = trees.fit_layout(df, ["few", "many", "one"], ["c"], {"c": 3})
    assert layout.cuts[0] == tuple(float(i) for i in range(7)) and layout.cuts[2] == (1.0,) and layout.sizes == (4,)
    assert len(layout.cuts[1]) == trees.MAX_BINS and layout.cuts[1][-1] == 2499.5


def test_saved_trees_score_alike(spark, tmp_path):
    from cmdprism.catalog.telemetry import telemetry
    from cmdprism.functions.features import build_features

    events = build_features(telemetry(spark, "/root/testdata/sf0.001"))
    for train in (models.train_gbdt, models.train_random_forest):
        detector = train(events, {"n_estimators": 5})
        models.save_detector(spark, detector, f"{tmp_path}/{detector.name}")
        loaded = models.load_detector(spark, f"{tmp_path}/{detector.name}")
        both = loaded.score(detector.score(events), "again")
        assert both.where(F.abs(F.col("again") - F.col(f"prob_{detector.name}")) > 0).count() == 0

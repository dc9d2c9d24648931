import zlib

import numpy as np

from cmdprism.llm import quality
from cmdprism.llm.queries import QUERIES


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    scores, grades, free = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-1.0, 0.3, -0.2])
    loss, by_score, by_free = quality.loss_and_gradient(scores, grades, free)
    step = 1e-6
    for i in range(5):
        moved = scores.copy()
        moved[i] += step
        assert abs((quality.loss_and_gradient(moved, grades, free)[0] - loss) / step - by_score[i]) < 1e-3
    for k in range(3):
        moved = free.copy()
        moved[k] += step
        assert abs((quality.loss_and_gradient(scores, grades, moved)[0] - loss) / step - by_free[k]) < 1e-3


def test_thresholds_stay_ordered():
    assert (np.diff(quality.thresholds(np.array([5.0, -9.0, 2.0]))) > 0).all()


def test_minimise_finds_the_least_value_of_a_bowl():
    scale = np.array([1.0, 10.0, 100.0])
    goal = np.array([3.0, -2.0, 0.5])
    found = quality.minimise(lambda x: (float((scale * (x - goal) ** 2).sum()), 2 * scale * (x - goal)), np.zeros(3), 200)
    assert np.abs(found - goal).max() < 0.02


def test_grades_of_made_up_documents(spark):
    """Three grades told apart by how much of a text is junk."""
    rng = np.random.default_rng(1)
    rows, ratings = [], []
    for i in range(600):
        grade = i % 3
        words = [str(x) for x in rng.choice(["river", "stone", "light", "walks", "under", "again"], 40)]
        for k in rng.choice(40, [30, 12, 0][grade], replace=False):
            words[k] += "$$%%"
        rows.append((i, " ".join(words)))
        ratings.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(ratings, "doc_id long, g int")
    model = quality.fit(docs, rated.where("doc_id % 4 <> 0"), rated["g"])
    expected = [model.predict(t, 1)[0] for _, t in rows]
    tails = [model.tails(t) for _, t in rows[:30]]
    assert all((np.diff(x) <= 0).all() and (x >= 0).all() and (x <= 1).all() for x in tails)
    held = [(e, g) for e, (i, g) in zip(expected, ratings, strict=True) if i % 4 == 0]
    means = [np.mean([e for e, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.5 < means[1] and means[1] + 0.5 < means[2]
    assert np.mean([round(e) == g for e, g in held]) > 0.9


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_grades"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["keep"], good[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in good]
    assert np.mean([k == (g == 1) for k, g in held]) >= 0.95


def test_nulls_single_grades_and_empty_tables(spark):
    schema = "doc_id long, text string, tail string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", None), (2, "b " * 50_000, "x")], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (3, None, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.op9(docs, labels).collect()) == 4
    assert {r["expected_grade"] for r in quality.op9(docs, labels.where("false")).collect()} == {0.0}
    only = quality.op9(docs, labels.where("quality = 1 and toxic = 0"))
    assert all(0 <= r["tail"] <= 1 for r in only.collect())
    assert quality.op9(docs.where("false"), labels).collect() == []


def test_fit_and_scores_equal_plain_loops(spark):
    """The fitted model has no slope by a plain sum over all rows and terms, and grades follow from its weights and thresholds."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(str(x) for x in rng.choice(["good", "poor", "text", "!!", "words", "line"], 12))) for i in range(80)]
    ratings = [(i, min(2, t.count("good"))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rated = spark.createDataFrame(ratings, "doc_id long, g int")
    buckets = 64
    model = quality.fit(docs, rated, rated["g"], buckets=buckets, rounds=400)
    weights, cuts = model.weights, list(quality.thresholds(model.free))

    def plain(w, free):
        total = 0.0
        bounds = quality.thresholds(free)
        for (_, text), (_, grade) in zip(rows, ratings, strict=True):
            at, x = quality.features(text, buckets)
            score = sum(float(v) * w[int(i)] for i, v in zip(at, x, strict=True))
            below = [0.0, *[1 / (1 + np.exp(-(b - score))) for b in bounds], 1.0]
            total -= np.log(max(below[grade + 1] - below[grade], 1e-300))
        return total / len(rows) + quality.RIDGE / 2 * float(w @ w)

    step = 1e-5
    at_end = plain(weights, model.free)
    start = plain(np.zeros(buckets), model.free)
    assert at_end < start
    for i in list(rng.choice(buckets, 12, replace=False)):
        up, down = weights.copy(), weights.copy()
        up[i] += step
        down[i] -= step
        assert abs(plain(up, model.free) - plain(down, model.free)) / (2 * step) < 5e-3
    for _, text in rows[:20]:
        at, x = quality.features(text, buckets)
        score = sum(float(v) * weights[int(i)] for i, v in zip(at, x, strict=True))
        tails = [1 - 1 / (1 + np.exp(-(b - score))) for b in cuts]
        expected, tail = model.predict(text, 1)
        assert abs(expected - sum(tails)) < 1e-9 and abs(tail - tails[0]) < 1e-9

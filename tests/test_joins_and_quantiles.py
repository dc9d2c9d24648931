"""Nearest-value join and exact quantiles against plain Python."""

import math
import random

import numpy as np
import pytest

from cmdprism.plans import prefix
from cmdprism.plans.nearest import nearest_rows
from cmdprism.plans.quantiles import exact_quantiles


def plain_nearest(points, target):
    """(value, name) of the closest point, the lower value and then the smallest name on ties."""
    group, value = target
    own = [(v, n) for g, v, n in points if g == group and v is not None]
    if value is None or not own:
        return None
    return min(own, key=lambda p: (abs(p[0] - value), p[0], p[1]))


@pytest.mark.parametrize("rows_each", [7, 1 << 20])
def test_nearest_rows_equal_a_plain_search(spark, monkeypatch, rows_each):
    monkeypatch.setattr(prefix, "MAX_RANGE_ROWS", rows_each)
    rng = random.Random(rows_each)
    points = [(rng.choice(["a", "b", None, "only points"]), rng.choice([None, *[float(i) for i in range(0, 90, 3)]]), f"n{i}") for i in range(150)]
    targets = [(i, rng.choice(["a", "b", None, "no points"]), rng.choice([None, 4.5, 7.0, rng.random() * 120 - 10])) for i in range(250)]
    p = spark.createDataFrame(points, "g string, v double, name string")
    t = spark.createDataFrame(targets, "id int, g string, v double")
    got = {r["id"]: r["nearest"] and (r["nearest"]["v"], r["nearest"]["name"]) for r in nearest_rows(p, t, "v", ["g"]).collect()}
    assert got == {i: plain_nearest(points, (g, v)) for i, g, v in targets}


def test_nearest_rows_without_groups_and_with_one_hot_value(spark, monkeypatch):
    monkeypatch.setattr(prefix, "MAX_RANGE_ROWS", 10)
    points = [(float(i), i) for i in range(20)]
    targets = [(i, 5.5) for i in range(300)] + [(1000, -3.0), (1001, 99.0)]
    p = spark.createDataFrame(points, "v double, k int")
    t = spark.createDataFrame(targets, "id int, at double")
    rows = nearest_rows(p, t, "v", target_value="at").collect()
    assert len(rows) == 302
    assert {r["nearest"]["k"] for r in rows if r["id"] < 1000} == {5}
    assert {r["id"]: r["nearest"]["k"] for r in rows if r["id"] >= 1000} == {1000: 0, 1001: 19}
    assert [r["nearest"] for r in nearest_rows(p.limit(0), t, "v", target_value="at").collect()] == [None] * 302


def test_nearest_rows_read_each_range_once_per_direction(spark):
    """A frame up to the end of its range is summed up anew for every row: quadratic in the rows of a range."""
    p = spark.createDataFrame([(1.0, 1)], "v double, k int")
    plan = nearest_rows(p, p.select("v"), "v")._jdf.queryExecution().executedPlan().toString().lower()
    assert "rangeframe" in plan and "unboundedfollowing" not in plan


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("few, steps", [(4096, 1000), (5, 10), (1, 4)])
def test_quantiles_equal_sorted_values(spark, few, steps):
    rng = np.random.default_rng(few)
    groups = {
        "distinct": rng.normal(size=700), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([3.5]), "same": np.full(300, 2.0),
        "two ends": np.repeat([1.0, 9.0], [150, 151]), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 100))]),
        None: rng.normal(size=40),
    }
    rows = [(g, float(v), float(-v) / 2) for g, values in groups.items() for v in values]
    rows += [("distinct", None, float("nan")), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {(r["g"], r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, ["a", "b"], PROBS, ["g"], few, steps).collect()}
    assert len(got) == len(groups) * 2 * len(PROBS)
    for g, values in groups.items():
        for name, own in (("a", values), ("b", -values / 2)):
            for p in PROBS:
                own = np.sort(own)
                at = p * (len(own) - 1)
                low, high = own[math.floor(at)], own[math.ceil(at)]
                assert got[g, name, p] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)


def test_quantiles_of_nothing_and_of_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),), (float("inf"),)], "a double")
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["a"], [0.0, 1 / 3, 1.0]).collect()}
    assert got == {0.0: float("-inf"), 1 / 3: 1.0, 1.0: float("inf")}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]).collect() == []

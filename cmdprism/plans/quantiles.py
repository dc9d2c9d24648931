"""Exact quantiles by rank selection: no task keeps a counter per distinct value.

A sketch (``percentile_approx``) brackets the wanted rank of every group and column; one aggregate counts the rows below the
bracket and at its ends. A rank that falls on an end is found. Else the bracket is narrowed to the rows strictly inside, until so
few are left that one group may sort them. Each round leaves a few steps of the sketch, whatever the values, and ties
of any number end on an end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.sources.tables import materialize

#: Accuracy of the sketch, and its percentiles that may be ends of a bracket.
ACCURACY, STEPS = 10_000, 1_000
#: Rows of a bracket that one group sorts.
FEW = 4_096


def _rows(narrow: DataFrame, brackets: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """The values strictly between ``low`` and ``high`` (NULL: no end) of every bracket, with the bracket's columns."""
    named = brackets.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    inside = (F.col(low).isNull() | (F.col("v") > F.col(low))) & (F.col(high).isNull() | (F.col("v") < F.col(high)))
    return narrow.join(named, reduce(lambda a, b: a & b, [*same, inside])).drop(*[f"_b_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (), few: int = FEW, steps: int = STEPS
) -> DataFrame:
    """(by..., column, prob, value): quantiles with linear interpolation of all columns and groups at once.

    NULL and NaN take no part, and a group without values has no row. Null keys are a group of their own.
    """
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    values = df.select(*by, F.inline(items)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    narrow = materialize(values, "quantile-values")
    keys = [*by, "column"]
    # The quantile lies between the rows before and behind the place p * (n - 1).
    place = F.col("prob") * (F.col("n") - 1)
    sizes = narrow.groupBy(*keys).agg(F.count("*").alias("n"))
    each = sizes.select(*keys, F.explode(F.lit([float(p) for p in probs])).alias("prob"), "n")
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")
    wanted = materialize(each.select(*keys, "prob", (place - F.floor(place)).alias("part"), ranks), "quantile-ranks")
    nothing = F.lit(None).cast("double")
    brackets = wanted.select(*keys, "rank").distinct()
    brackets = brackets.select(*keys, "rank", F.lit(0).cast("long").alias("below"), nothing.alias("low"), nothing.alias("high"))
    found: list[DataFrame] = []
    while not brackets.isEmpty():
        brackets = materialize(_narrowed(narrow, brackets, keys, steps), "quantile-brackets")
        found.append(_sorted(narrow, brackets.where(F.col("inside") <= few), keys))
        counted = materialize(_counted(narrow, brackets.where(F.col("inside") > few), keys), "quantile-counts")
        at_low = (F.col("rank") >= F.col("less")) & (F.col("rank") < F.col("less") + F.col("n_low"))
        at_high = (F.col("rank") >= F.col("upto") - F.col("n_high")) & (F.col("rank") < F.col("upto"))
        found.append(counted.where(at_low | at_high).select(*keys, "rank", F.when(at_low, F.col("low")).otherwise(F.col("high")).alias("value")))
        # Strictly inside; where the sketch missed the rank, the part of the old bracket beside it.
        before, behind = F.col("rank") < F.col("less"), F.col("rank") >= F.col("upto")

        def either(left: Column, right: Column, inner: Column, before: Column = before, behind: Column = behind) -> Column:
            return F.when(before, left).when(behind, right).otherwise(inner)

        brackets = counted.where(~at_low & ~at_high).select(
            *keys, "rank", either(F.col("below"), F.col("upto"), F.col("less") + F.col("n_low")).alias("below"),
            either(F.col("old_low"), F.col("high"), F.col("low")).alias("low"), either(F.col("low"), F.col("old_high"), F.col("high")).alias("high"),
        )
    if not found:
        return narrow.select(*keys, F.lit(0.0).alias("prob"), F.lit(0.0).alias("value")).limit(0)
    every = reduce(DataFrame.unionByName, found).withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "rank"]})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in [*keys, "rank"]]
    ends = wanted.join(every, reduce(lambda a, b: a & b, same))
    low, high = F.min("value"), F.max("value")
    # Equal ends make no difference, which matters for infinite ones.
    value = F.when(low == high, low).otherwise(low + (high - low) * F.first("part"))
    return ends.groupBy(*keys, "prob").agg(value.alias("value"))


def _narrowed(narrow: DataFrame, brackets: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Every bracket with the number of values inside, and new ends around its rank from a sketch of these."""
    shares = F.lit([i / steps for i in range(steps + 1)])
    grouped = _rows(narrow, brackets, keys, "low", "high").groupBy(*keys, "rank", "below", "low", "high")
    sketch = grouped.agg(F.count("*").alias("inside"), F.percentile_approx("v", shares, ACCURACY).alias("p"))
    share = (F.col("rank") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * steps
    return sketch.select(
        *keys, "rank", "below", "inside", F.col("low").alias("old_low"), F.col("high").alias("old_high"),
        F.element_at("p", F.greatest(F.floor(share), F.lit(1)).cast("int")).alias("low"),
        F.element_at("p", F.least(F.ceil(share) + 2, F.lit(steps + 1)).cast("int")).alias("high"),
    )


def _sorted(narrow: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted values of brackets with few rows."""
    rows = _rows(narrow, brackets, keys, "old_low", "old_high")
    ordered = rows.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("x"))
    return ordered.select(*keys, "rank", F.element_at("x", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))


def _counted(narrow: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Every bracket with the rows below its new low end, up to its new high end, and at the ends."""
    rows = _rows(narrow, brackets, keys, "old_low", "old_high")
    grouped = rows.groupBy(*keys, "rank", "below", "old_low", "old_high", "low", "high")
    return grouped.agg(
        (F.col("below") + F.count_if(F.col("v") < F.col("low"))).alias("less"), F.count_if(F.col("v") == F.col("low")).alias("n_low"),
        (F.col("below") + F.count_if(F.col("v") <= F.col("high"))).alias("upto"), F.count_if(F.col("v") == F.col("high")).alias("n_high"),
    )

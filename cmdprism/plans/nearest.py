"""Nearest-value join of two large tables: for every target the point with the closest value, within groups.

Points and targets are dealt into ranges of values together. Windows look back and ahead within a range only; the last point
of each range is carried into the ranges behind it, and the first one into those before, by a window over one row per range. So
no pair of a point and a target is formed but the two that a target looks at, and no window holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdprism.plans.prefix import in_ranges


def nearest_rows(points: DataFrame, targets: DataFrame, value: str, by: list[str] = (), target_value: str | None = None) -> DataFrame:
    """All rows of ``targets`` with a struct ``nearest`` of the closest point's columns, the lower one on ties.

    Among points of equal value the one whose other columns are smallest, in their order, is met. A target without points in its group, or with a
    NULL value, has a NULL ``nearest``; points with a NULL value take no part. NULL keys match.
    """
    target_value = target_value or value
    fields = [value, *[c for c in points.columns if c not in (value, *by)]]
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    # One point for each value of a group; targets keep all their columns in one.
    distinct = points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*named, F.col(value).cast("double").alias("_v")).agg(
        F.min(F.struct(*fields)).alias("_point")
    )
    aimed = targets.select(*named, F.col(target_value).cast("double").alias("_v"), F.struct(*[F.col(c) for c in targets.columns]).alias("_target"))
    both = distinct.unionByName(aimed, allowMissingColumns=True).withColumns({"_one": F.lit(1), "_row": F.monotonically_increasing_id()})
    # Targets of one value spread over ranges as well: points of that value are carried to all of them.
    placed = in_ranges(both, ["_one", *keys], [F.col("_v"), F.col("_row")], "nearest")
    seen = F.when(F.col("_point").isNotNull(), F.struct("_v", "_point"))
    ends = placed.groupBy(*keys, "_range").agg(F.max_by(seen, F.when(seen.isNotNull(), F.col("_v"))).alias("_last"), F.min_by(seen, F.when(seen.isNotNull(), F.col("_v"))).alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # What lies ahead is looked up backwards: a frame that ends with its group is summed up anew for every row.
    behind = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_c{k}") for k in [*keys, "_range"]], F.last("_last", True).over(ahead).alias("_before"), F.last("_first", True).over(behind).alias("_after")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in [*keys, "_range"]])
    inner = Window.partitionBy(*keys, "_range")
    # Rows of equal value see each other, so a point of the very value is met from both sides.
    back, front = (
        F.last(seen, True).over(inner.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        for order in (F.col("_v").asc(), F.col("_v").desc())
    )
    looked = placed.select("*", back.alias("_back"), front.alias("_front")).where(F.col("_target").isNotNull()).join(carried, same, "left")
    lower, upper = F.coalesce("_back", "_before"), F.coalesce("_front", "_after")
    near = _closer(lower, upper)
    return looked.select("_target.*", F.when(F.col("_v").isNotNull() & ~F.isnan("_v"), near).alias("nearest"))


def _closer(lower: Column, upper: Column) -> Column:
    gap_down, gap_up = F.col("_v") - lower["_v"], upper["_v"] - F.col("_v")
    return F.when(lower.isNull() | (gap_up < gap_down), upper["_point"]).otherwise(lower["_point"])

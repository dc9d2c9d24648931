"""Ordered running totals without a single-task window.

Rows are written in ranges of bounded size; the totals of the ranges are summed first and their offsets joined
back, so the row-level windows run per range and in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdprism.sources.tables import materialize

#: Rows that one range holds on average at most; their number grows with the table.
MAX_RANGE_ROWS = 1 << 20
#: Rows of a table that one window may hold as they are.
ONE_RANGE_ROWS = 1 << 16
#: Quantiles of a key that may be ends of ranges; more ranges take a second aggregate.
KEY_STEPS = 1_000


def range_count(rows: int, least: int, most_rows: int = MAX_RANGE_ROWS) -> int:
    """Ranges for so many rows: the session's shuffle partitions, or more where those would be too large."""
    return max(1, least, -(-rows // most_rows))


def in_ranges(df: DataFrame, by: list[str], order: list, name: str = "ranges") -> DataFrame:
    """``df`` written in ranges of ``by`` and ``order``, with the number of its range in ``_range``.

    Both writes go to the shared folder: the input is computed once, and the ranges stay as they are for every reader.
    """
    staged = materialize(df, name)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = range_count(staged.count(), least)
    placed = staged.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id())
    return materialize(placed, name)


def in_key_ranges(df: DataFrame, key: Column, name: str = "ranges") -> DataFrame:
    """``df`` written once, with ``_range``, the number of the range that ``key`` falls into.

    The ends of the ranges are quantiles of the key, from one small aggregate, so the range is a function of the row: no second
    write, and a task that runs again places its rows alike. A table of at most ONE_RANGE_ROWS is one range.
    """
    staged = materialize(df.withColumn("_key", key.cast("double")), name)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged.count()
    if rows <= ONE_RANGE_ROWS:
        return staged.withColumn("_range", F.lit(0)).drop("_key")
    number = F.when(~F.isnan("_key"), F.col("_key"))
    shares = F.lit([i / KEY_STEPS for i in range(1, KEY_STEPS)])
    ends = staged.agg(F.percentile_approx(number, shares, 10 * KEY_STEPS)).first()[0]
    ranges = range_count(rows, least)
    if ends and ranges > KEY_STEPS:
        finer = F.lit([i / ranges for i in range(1, ranges)])
        ends = staged.agg(F.percentile_approx(number, finer, 10 * ranges)).first()[0]
    picked = sorted({ends[(i * (len(ends) + 1)) // ranges - 1] for i in range(1, ranges)} if ends and ranges > 1 else set())
    return with_score_bucket(staged, "_key", picked, "_range").drop("_key")


def with_score_bucket(df: DataFrame, col: str, bounds: list[float], bucket: str = "_bucket") -> DataFrame:
    """Number of bounds less than or equal to the value, found by binary search."""
    inf = float("inf")
    inner = [b for b in bounds if -inf < b < inf]
    splits = [-inf, *inner, inf] if inner else [-inf, 0.0, inf]
    out = Bucketizer(splits=splits, inputCol="_bucket_in", outputCol="_bucket_out", handleInvalid="keep").transform(
        df.withColumn("_bucket_in", F.when(F.col(col).isNull() | F.isnan(col), -inf).otherwise(F.col(col)))
    )
    return out.withColumn(bucket, F.col("_bucket_out").cast("int")).drop("_bucket_in", "_bucket_out")


def running_totals(df: DataFrame, by: list[str], order: list, sums: list[str], key: Column | None = None) -> DataFrame:
    """Add ``<sum>_before`` (rows ahead within ``by``) and ``<sum>_total`` for every sum column.

    Rows that are equal in ``by`` and ``order`` stand in one range, so callers sum them up before. A window sees one range,
    or one row for each range of a ``by`` group. ``key``: a number that never falls along ``order`` and that few rows share; with
    it the rows are written once.
    """
    placed = in_ranges(df, by, order) if key is None else in_key_ranges(df, key)
    per_range = placed.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = per_range.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(s).over(everything).alias(f"{s}_total") for s in sums],
    )
    keys = [*by, "_range"]
    offsets = offsets.withColumnsRenamed({k: f"_offset_{k}" for k in keys})
    # NULL keys match as well.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_offset_{k}")) for k in keys])
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, same, "left")
        .withColumns(
            {f"{s}_before": F.coalesce(F.sum(s).over(local), F.lit(0)) + F.col(f"_{s}_offset") for s in sums}
        )
        .drop("_range", *[f"_{s}_offset" for s in sums], *[f"_offset_{k}" for k in keys])
    )


def digest_key(digest: Column) -> Column:
    """A number in the order of a hexadecimal digest: its first 52 bits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def rank_in_order(
    df: DataFrame, by: list[str], order: list, rank: str = "_rank", total: str = "_n", key: Column | None = None
) -> DataFrame:
    """0-based rank of each row in ``order``, which must be unique, and the row count, within ``by``."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, ["_one"], key)
    return ranked.withColumnsRenamed({"_one_before": rank, "_one_total": total}).drop("_one")

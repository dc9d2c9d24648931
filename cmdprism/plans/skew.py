"""Attach one value per group to many rows when some groups are very large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
#: Bytes of keys that the hot groups may have to be broadcast.
HOT_BYTES = 8 << 20
SPREAD = 4096


def attach_group_values(
    rows: DataFrame, groups: DataFrame, key: str, size: str, values: list[str], spread_by: str
) -> DataFrame:
    """Left join of ``values`` from ``groups`` (one row per ``key``, with its row count ``size``).

    Groups with at least 1/HOT_SHARE of all rows number HOT_SHARE at most; where their longest key keeps them under HOT_BYTES they
    are broadcast, else Spark chooses how they are met. Their rows take the value from it and are then spread over
    the shuffle by a key that matches nothing, made from ``spread_by`` so that a repeated task
    sends each row to the same place. All other rows meet in an ordinary join, in which no key
    is large. ``groups`` is read three times and should be a written table.
    """
    names = {v: f"_hot_{v}" for v in values}
    total, longest = groups.agg(F.sum(size), F.max(F.octet_length(F.col(key).cast("string")))).first()
    total = total or 0
    hot = groups.where(F.col(size) * HOT_SHARE >= total).select(
        key, F.lit(True).alias("_hot"), *[F.col(v).alias(names[v]) for v in values]
    )
    # A hash leads the key: rows are sorted by whole numbers, not by texts that begin alike. The key itself still has to be equal.
    own, digest = F.col(key).cast("string"), F.xxhash64(F.col(key).cast("string"))
    staged = rows.join(F.broadcast(hot) if (longest or 0) * HOT_SHARE <= HOT_BYTES else hot, key, "left").withColumns(
        {
            "_join_hash": F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(digest),
            "_join_key": F.when(F.col("_hot").isNull(), own),
        }
    )
    cold = groups.select(digest.alias("_join_hash"), own.alias("_join_key"), *values)
    joined = staged.join(cold, ["_join_hash", "_join_key"], "left")
    out = {v: F.when(F.col("_hot"), F.col(names[v])).otherwise(F.col(v)) for v in values}
    return joined.withColumns(out).select(*rows.columns, *values)

"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with the share p of all tokens gets a weight in proportion to p**a. Entropy of the weights falls and
the repetition of small sources falls as the exponent a rises from 0 to 1, so a is found by bisection: the largest
a whose entropy reaches the target, raised as far as the repetition limit asks. Each bisection step is one
aggregate that looks at many exponents at once; the table of sources never leaves Spark.

Weights become token budgets (by default the smallest total that uses every source whole once). A source's documents
are dealt into blocks by hash; each epoch orders the blocks by another hash and the documents of a block by a third.
Whole epochs take every document, the last one the documents whose tokens, added up in that order, fit the rest.

Defined results: a null source is a source of its own. Null or empty texts have no tokens: they are taken in every
whole epoch, and in the last one if they stand before its end; a source without any tokens is taken once. Equal hashes go by id. Repeated rows count and
are taken alike. An empty table gives no rows; one source alone keeps weight 1. ``epoch``, ``block``, ``block_order``,
``row_order`` and ``n_tokens`` are added; columns of the same names are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdprism.llm.common import Aside
from cmdprism.sources.tables import materialize

#: Share of the highest possible entropy that the weights must reach.
TARGET_ENTROPY = 0.97
#: Times that any source may be repeated when the budget is used.
MAX_EPOCHS = 4.0
BLOCK_ROWS = 1024
SEED = 17
#: Exponents looked at in one bisection step, and steps: 64**5 parts of the range.
PARTS, STEPS = 64, 5
#: The upper 12 bits of a block's order part the blocks of a source into 4096 super-blocks.
SUPER_SHIFT = 52


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def at_exponents(shares: DataFrame, low: float, high: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, highest weight/share) at evenly spaced exponents: one job."""
    grid = shares.select("p", F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("i"))
    a = F.lit(low) + F.col("i") * ((high - low) / PARTS)
    raw = F.pow("p", a)
    sums = grid.groupBy("i").agg(
        F.sum(raw).alias("z"), F.sum(raw * F.log(raw)).alias("zl"), F.max(raw / F.col("p")).alias("top")
    )
    rows = sums.select("i", (F.log("z") - F.col("zl") / F.col("z")).alias("h"), (F.col("top") / F.col("z")).alias("r")).collect()
    return [(low + r["i"] * (high - low) / PARTS, r["h"], r["r"]) for r in sorted(rows, key=lambda r: r["i"])]


def bisect(shares: DataFrame, fits, rising: bool) -> float | None:
    """The end of the exponents in [0, 1] for which ``fits(entropy, ratio)`` holds: the largest, or with ``rising``
    the smallest. None if there is none."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = at_exponents(shares, low, high)
        good = [i for i, (_, h, r) in enumerate(points) if fits(h, r)]
        if not good:
            return None
        if rising:
            i = good[0]
            low, high = points[max(0, i - 1)][0], points[i][0]
        else:
            i = good[-1]
            low, high = points[i][0], points[min(PARTS, i + 1)][0]
        if low == high:
            break
    return high if rising else low


def exponent(shares: DataFrame, sources: int, target: float, max_epochs: float, budget_share: float | None) -> float:
    """Largest exponent that reaches the target entropy, raised to where no source is repeated too often.

    With the default budget, the largest source is used once, so a source of share p is repeated
    (p_max / p)**(1 - a) times; with a set budget, weight / share * budget / tokens times.
    """
    wanted = target * math.log(sources) - 1e-12
    a = bisect(shares, lambda h, r: h >= wanted, rising=False)
    a = 1.0 if a is None else a
    if budget_share is None:
        top, least = shares.agg(F.max("p"), F.min("p")).first()
        lowest = 1 - math.log(max_epochs) / math.log(top / least) if top > least else 0.0
    else:
        lowest = bisect(shares, lambda h, r: r * budget_share <= max_epochs, rising=True)
        lowest = 1.0 if lowest is None else lowest
    return max(a, lowest, 0.0)


def z_of(shares: DataFrame, a: float) -> float:
    return shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]


def source_budgets(
    docs: DataFrame, target: float, max_epochs: float, budget: int | None
) -> tuple[DataFrame, float]:
    """Per source: tokens, weight, budget; and the exponent. ``docs`` has ``_source`` and ``_tokens``."""
    sums = materialize(docs.groupBy("_source").agg(F.sum("_tokens").alias("tokens")), "mixing-sources")
    total, sources = sums.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        empty = sums.select("_source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
        return empty, 1.0
    shares = sums.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares, sources, target, max_epochs, None if budget is None else budget / total)
    z = z_of(shares, a)
    weight = F.pow("p", F.lit(a)) / z
    if budget is None:
        # The smallest budget at which every source is used whole at least once.
        budget_tokens = shares.agg(F.max(F.col("tokens") / weight)).first()[0]
    else:
        budget_tokens = float(budget)
    weighted = shares.withColumn("weight", weight)
    return (
        sums.select("_source", "tokens")
        .join(weighted.select(F.col("_source").alias("_s"), "weight"), F.col("_source") == F.col("_s"), "left")
        .select(
            "_source",
            "tokens",
            F.coalesce("weight", F.lit(0.0)).alias("weight"),
            F.coalesce(F.round(F.col("weight") * budget_tokens).cast("long"), F.lit(0)).alias("budget"),
        ),
        a,
    )


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """One row for every copy of a document in the mix, with its epoch and place.

    Sorting by (epoch, block_order, block, row_order) gives each source's block permutation. Documents are shuffled once, by
    (source, block); blocks of all sources number about rows / ``block_rows`` each, so a hot source is spread like the others.
    """
    aside = Aside(docs)
    text_col, source_col, id_col = aside[text_col], aside[source_col], aside[id_col]
    staged = aside.rows.withColumns({"_source": source_name(F.col(source_col)), "_tokens": token_count(F.col(text_col))})
    rows = docs.count()
    budgets, _ = source_budgets(staged, target_entropy, max_epochs, budget)
    blocks = max(1, -(-rows // block_rows))
    staged = staged.withColumns(
        {
            "_block": F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(blocks)).cast("long"),
            "_row": F.xxhash64(F.lit(seed + 1), id_col, text_col),
        }
    )
    totals = staged.groupBy("_source", "_block").agg(F.sum("_tokens").alias("block_tokens"))
    plan = (
        totals.join(budgets.select("_source", "tokens", "budget"), "_source")
        .withColumn("_whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long"))
        .withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
        .withColumn("_rest", F.when(F.col("_rest") > 0, F.col("_rest")).otherwise(-1))
        .withColumn("_key", F.xxhash64(F.lit(seed + 2), "_whole", "_source", "_block"))
        .withColumn("_super", F.shiftright("_key", SUPER_SHIFT))
    )
    # Tokens before each block in the last epoch's order: super-blocks first, so no window holds all blocks of a source.
    by_super = plan.groupBy("_source", "_super").agg(F.sum("block_tokens").alias("super_tokens"))
    ahead = Window.partitionBy("_source").orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_super.select("_source", "_super", F.coalesce(F.sum("super_tokens").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_super").orderBy("_key", "_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.join(offsets, ["_source", "_super"]).select(
        "_source",
        "_block",
        "_whole",
        "_rest",
        (F.col("_offset") + F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))).alias("_before"),
    )
    # The hash covers id and text, so rows it can't tell apart are repeated rows; without the text a query of ids needs no texts here.
    own = Window.partitionBy("_source", "_block").orderBy("_row", id_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = staged.join(plan, ["_source", "_block"]).withColumn(
        "_take", F.col("_whole") + (F.col("_before") + F.sum("_tokens").over(own) <= F.col("_rest")).cast("long")
    )
    copies = placed.where("_take > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_take") - 1)))
    return copies.select(
        *aside.back("n_tokens", "epoch", "block", "block_order", "row_order"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        F.xxhash64(F.lit(seed + 2), "_epoch", "_source", "_block").alias("block_order"),
        F.col("_row").alias("row_order"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).drop("text")

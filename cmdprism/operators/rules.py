"""Rule mining and rule application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from cmdprism.functions.numbers import ratio
from cmdprism.plans.quantiles import exact_quantiles
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import LABEL, ROW_ID
from cmdprism.sources.tables import materialize

# Features that rules may use, in rule order.
RULE_FLAGS = [
    "has_powershell", "has_encodedcommand", "has_base64", "has_download", "has_iwr", "has_curl", "has_certutil",
    "has_bitsadmin", "has_wmic", "has_rundll32", "has_reg_add", "has_schtasks", "has_mshta", "has_cmd", "has_bypass",
]
RULE_NUMERICS = ["cmd_length", "cmd_token_count", "num_special_chars"]
RULE_CATEGORIES = ["source_image_base"]
# Support and rate limits of mined rules.
MIN_SUPPORT = 3
FLAG_LIFT = 0.25
FLAG_RATE = 0.7
CATEGORY_RATE = 0.8
MALICIOUS_QUANTILE = 0.75
BENIGN_QUANTILE = 0.9


def mine_boolean_rules(features: DataFrame, flags: list[str] = RULE_FLAGS, label: str = LABEL) -> DataFrame:
    """Flags with enough support whose positive rate clears the base rate.

    One aggregate row holds the sums of all flags and is unpivoted afterwards, so rows are
    not multiplied by the number of flags before the shuffle.
    """
    sums = []
    for flag in flags:
        fired = F.col(flag) > 0.5
        sums += [
            F.count_if(fired).alias(f"_s_{flag}"),
            F.count_if(fired & (F.col(label) == 1)).alias(f"_p_{flag}"),
        ]
    row = features.agg(F.avg(F.col(label).cast("double")).alias("base_rate"), *sums)
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(flag).alias("feature"),
                F.col(f"_s_{flag}").alias("support"), F.col(f"_p_{flag}").alias("positives"),
            )
            for i, flag in enumerate(flags)
        ]
    )
    stats = row.select("base_rate", F.inline(items)).withColumn("rate", ratio(F.col("positives"), F.col("support")))
    limit = F.greatest(F.col("base_rate") + FLAG_LIFT, F.lit(FLAG_RATE))
    return stats.where((F.col("support") >= MIN_SUPPORT) & (F.col("rate") >= limit)).drop("positives")


def mine_numeric_rules(features: DataFrame, numerics: list[str] = RULE_NUMERICS, label: str = LABEL) -> DataFrame:
    """Features whose malicious upper quartile lies above the benign 90th percentile.

    The percentiles are exact. Whole numbers are few different ones, so each task keeps a counter for each; quantiles of
    fractions, which may all differ, are found by rank. Without benign rows the rule is kept.
    """
    fractions = [n for n in numerics if isinstance(features.schema[n].dataType, FractionalType)]
    parts = []
    for name in numerics:
        if name not in fractions:
            value = F.col(name).cast("double")
            parts += [
                F.percentile(F.when(F.col(label) == 1, value), F.lit(MALICIOUS_QUANTILE)).alias(f"_hi_{name}"),
                F.percentile(F.when(F.col(label) == 0, value), F.lit(BENIGN_QUANTILE)).alias(f"_lo_{name}"),
            ]
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(name).alias("feature"),
                F.col(f"_hi_{name}").alias("threshold"), F.col(f"_lo_{name}").alias("benign_p90"),
            )
            for i, name in enumerate(numerics)
        ]
    )
    stats = features.agg(F.count("*").alias("_n"), *parts)
    if fractions:
        found = exact_quantiles(features, fractions, [MALICIOUS_QUANTILE, BENIGN_QUANTILE], [label])
        wanted = (F.col(label) == 1) & (F.col("prob") == MALICIOUS_QUANTILE) | (F.col(label) == 0) & (F.col("prob") == BENIGN_QUANTILE)
        ends = found.where(wanted).groupBy().agg(
            *[
                F.max(F.when((F.col("column") == name) & (F.col(label) == side), F.col("value"))).alias(f"_{end}_{name}")
                for name in fractions
                for side, end in ((1, "hi"), (0, "lo"))
            ]
        )
        both = stats.unionByName(ends, allowMissingColumns=True)
        stats = both.agg(*[F.max(c).alias(c) for c in both.columns])
    stats = stats.select(F.inline(items))
    above = F.col("benign_p90").isNull() | (F.col("threshold") > F.col("benign_p90"))
    return stats.where(F.col("threshold").isNotNull() & above)


def mine_category_rules(
    features: DataFrame, categories: list[str] = RULE_CATEGORIES, label: str = LABEL
) -> DataFrame:
    """Category values with enough support and a high positive rate, one row per value."""
    tables = []
    for i, name in enumerate(categories):
        value = F.coalesce(F.col(name), F.lit(""))
        stats = features.groupBy(value.alias("category")).agg(
            F.count(label).alias("support"), F.sum(label).cast("bigint").alias("positives")
        )
        tables.append(
            stats.select(
                F.lit(i).alias("ordinal"), F.lit(name).alias("feature"), "category", "support",
                ratio(F.col("positives"), F.col("support")).alias("rate"),
            )
        )
    every = reduce(DataFrame.unionByName, tables)
    return every.where((F.col("support") >= MIN_SUPPORT) & (F.col("rate") >= CATEGORY_RATE))


def mine_rules(features: DataFrame, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """All mined rules: the rule table, and the hot category values in a table of their own.

    The value table has one row per value, because nothing bounds how many there are; the
    rule table has at most one row per feature. Both are written, so that applying the rules
    does not mine them again.
    """
    flags = mine_boolean_rules(features, label=label).select(
        "ordinal", F.col("feature").alias("name"), F.lit("bool").alias("kind"), "feature",
        F.lit(None).cast("double").alias("threshold"),
    )
    numerics = mine_numeric_rules(features, label=label).select(
        (F.col("ordinal") + len(RULE_FLAGS)).alias("ordinal"), F.concat(F.lit("high_"), "feature").alias("name"),
        F.lit("numeric").alias("kind"), "feature", "threshold",
    )
    mined = mine_category_rules(features, label=label).select("ordinal", "feature", "category", "support")
    values = materialize(mined, "rule-categories")
    hot = values.groupBy("ordinal", "feature").agg(F.count("*").alias("_n")).select(
        (F.col("ordinal") + len(RULE_FLAGS) + len(RULE_NUMERICS)).alias("ordinal"),
        F.concat(F.lit("hot_"), "feature").alias("name"), F.lit("category").alias("kind"), "feature",
        F.lit(None).cast("double").alias("threshold"),
    )
    return materialize(flags.unionByName(numerics).unionByName(hot), "rules"), values


def rules_with_categories(rules: DataFrame, values: DataFrame) -> DataFrame:
    """The exchange form of a rule set: one row per rule, category values as an array."""
    arrays = values.groupBy("feature").agg(F.sort_array(F.collect_list("category")).alias("categories"))
    joined = rules.join(arrays.withColumn("kind", F.lit("category")), ["feature", "kind"], "left")
    return joined.select("ordinal", "name", "kind", "feature", "threshold", "categories")


def categories_of(rules: DataFrame) -> DataFrame:
    """The value table of a rule set in exchange form."""
    return rules.where("kind = 'category'").select("feature", F.explode("categories").alias("category"))


def apply_rules(
    features: DataFrame, rules: DataFrame, values: DataFrame | None = None, row_id: str = ROW_ID
) -> DataFrame:
    """Add ``rule_label`` and ``fired_rules`` (names in rule order).

    Flag and threshold rules become column expressions; their number is bounded by the
    feature list, so they are read on the driver. Category rules are joins on the value table.
    """
    spec = rules.select("ordinal", "name", "kind", "feature", "threshold").orderBy("ordinal").collect()
    out, hits = features, []
    for rule in spec:
        column = F.coalesce(F.col(rule["feature"]), F.lit("" if rule["kind"] == "category" else 0))
        if rule["kind"] == "bool":
            hit: Column = column != 0
        elif rule["kind"] == "numeric":
            hit = column >= float(rule["threshold"] or 0.0)
        else:
            mark = f"_hit_{rule['name']}"
            listed = values.where(F.col("feature") == rule["feature"])
            if "support" not in values.columns:
                # A rule set read from its exchange form: count the rows, so that large categories are known.
                sizes = features.groupBy(column.alias("category")).agg(F.count("*").alias("support"))
                listed = materialize(listed.join(sizes, "category"), "rule-values")
            listed = listed.select(
                F.col("category").alias(f"_c_{rule['name']}"), F.col("support").alias("_support"), F.lit(True).alias(mark)
            )
            staged = out.withColumn(f"_c_{rule['name']}", column)
            out = attach_group_values(staged, listed, f"_c_{rule['name']}", "_support", [mark], spread_by=row_id).drop(
                f"_c_{rule['name']}"
            )
            hit = F.coalesce(F.col(mark), F.lit(False))
        hits.append(F.when(hit, F.lit(rule["name"])))
    fired = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return (
        out.withColumn("fired_rules", fired)
        .withColumn("rule_label", (F.size("fired_rules") > 0).cast("int"))
        .drop(*[f"_hit_{r['name']}" for r in spec])
    )


def predict_majority(df: DataFrame, majority: int) -> DataFrame:
    return df.withColumn("prediction", F.lit(majority))

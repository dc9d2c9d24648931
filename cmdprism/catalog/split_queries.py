"""Registered queries: splits, profiles, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cmdprism.catalog.metric_queries import REPORT, REPORT_COLUMNS, rounded, rounded_sql
from cmdprism.catalog.registry import query
from cmdprism.catalog.telemetry import (
    feature_sql,
    group_key_sql,
    normalized_sql,
    table,
    telemetry,
    with_features,
    with_telemetry,
)
from cmdprism.functions.features import build_features
from cmdprism.operators import metrics as m
from cmdprism.operators import profile as pf
from cmdprism.operators import rules as rl
from cmdprism.operators import splits as sp
from cmdprism.operators.ingest import add_group_key
from cmdprism.session import scratch_path
from cmdprism.sources import tables as tb

KEYED = f"""SELECT *, {group_key_sql('"SourceImage"', '"CommandLine"')} AS group_key FROM telemetry"""
STATS = """SELECT group_key, count(*) AS size, CAST(sum("_label") AS DOUBLE) / count(*) AS malicious_ratio,
  CASE WHEN CAST(sum("_label") AS DOUBLE) / count(*) >= 0.5e0 THEN 1 ELSE 0 END AS strat_label FROM keyed GROUP BY 1"""
GROUPS = """SELECT group_key, size, strat_label, CASE WHEN r < first THEN 'train' WHEN r < first + second THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, round((n - first) * (0.14e0 / (0.14e0 + 0.24e0))) AS second FROM (
  SELECT *, round(n * 0.62e0) AS first FROM (
    SELECT *, row_number() OVER (PARTITION BY strat_label ORDER BY sha256(concat(group_key, '|13'))) - 1 AS r,
      count(*) OVER (PARTITION BY strat_label) AS n FROM stats)))"""
ASSIGNED = 'SELECT row_id, group_key, split, "_label" FROM keyed JOIN groups USING (group_key)'


def with_splits(body: str, *extra: tuple[str, str]) -> str:
    return with_telemetry(body, ("keyed", KEYED), ("stats", STATS), ("groups", GROUPS), ("assigned", ASSIGNED), *extra)


def keyed(spark, sf_dir):
    return add_group_key(telemetry(spark, sf_dir))


@query(
    "e1_group_label_stats",
    with_splits("SELECT group_key, size, round(malicious_ratio, 6) AS malicious_ratio, strat_label FROM stats"),
)
def e1_group_label_stats(spark, sf_dir):
    return rounded(sp.group_label_stats(keyed(spark, sf_dir)), ["malicious_ratio"]).drop("positives")


@query("g1_split_groups", with_splits("SELECT group_key, size, strat_label, split FROM groups"))
def g1_split_groups(spark, sf_dir):
    return sp.split_groups(keyed(spark, sf_dir)).select("group_key", "size", "strat_label", "split")


@query("g1_stratified_group_split", with_splits("SELECT row_id, group_key, split FROM assigned"))
def g1_stratified_group_split(spark, sf_dir):
    return sp.stratified_group_split(keyed(spark, sf_dir))


@query(
    "g1_document_split",
    f"""WITH keyed AS (SELECT doc_id AS row_id, concat(lang, '::', {normalized_sql('text')}) AS group_key,
    CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS "_label" FROM documents),
stats AS ({STATS}), groups AS ({GROUPS}) SELECT row_id, split FROM keyed JOIN groups USING (group_key)""",
)
def g1_document_split(spark, sf_dir):
    """Copies of a document share their split; the key is the whole normalised text."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("lang").alias("SourceImage"),
        F.col("text").alias("CommandLine"),
        (F.col("n_chars") > 1500).cast("int").alias("_label"),
    )
    return sp.stratified_group_split(add_group_key(docs)).select("row_id", "split")


@query(
    "g2_rebalanced_split",
    with_splits(
        """SELECT CAST(sum(size) AS BIGINT) AS n_rows, CAST(sum("positives") AS BIGINT) AS malicious, count(*) AS n_groups,
  TRUE AS whole, TRUE AS closer FROM (SELECT group_key, count(*) AS size, CAST(sum("_label") AS BIGINT) AS positives FROM keyed GROUP BY 1)"""
    ),
)
def g2_rebalanced_split(spark, sf_dir):
    """Row targets 60/20/20: all groups are kept whole, and the splits are no further from their targets than before."""
    rows = keyed(spark, sf_dir)
    before = sp.split_table(rows)
    total = before.agg(F.sum("size")).first()[0]
    targets = {"train": total * 6 // 10, "val": total * 2 // 10, "test": total - total * 6 // 10 - total * 2 // 10}
    after = sp.split_table(rows, targets=targets)

    def off(table_):
        counts = {r["split"]: r["n"] for r in table_.groupBy("split").agg(F.sum("size").alias("n")).collect()}
        return sum(abs(counts.get(s, 0) - t) for s, t in targets.items())

    closer = off(after) <= off(before)
    assigned = sp.assign_rows(rows, after)
    per_group = assigned.groupBy("group_key").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("n"))
    whole = per_group.agg(F.bool_and(F.col("a") == F.col("b")).alias("whole"), F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"))
    malicious = after.agg(F.sum("positives")).first()[0]
    return whole.select("n_rows", F.lit(malicious).cast("bigint").alias("malicious"), "n_groups", "whole", F.lit(closer).alias("closer"))


# The greedy moves one by one on the size histogram, as plain SQL: a row of cells (split now, size, split at first, groups) is taken from
# step to step; the smallest group of the split most above its target goes to the one most below.
MOVES = 1000
REBALANCE_PARTS = (
    ("aims", "SELECT [n * 6 // 10, n * 2 // 10, n - n * 6 // 10 - n * 2 // 10] AS aim FROM (SELECT CAST(sum(size) AS BIGINT) AS n FROM groups)"),
    ("cells0", "SELECT list(struct_pack(now := split, size := size, origin := split, n := n) ORDER BY split, size) AS cells FROM (SELECT split, size, count(*) AS n FROM groups GROUP BY ALL)"),
    (
        "walk",
        f"""SELECT 0 AS step, cells, aim, FALSE AS done FROM cells0, aims
  UNION ALL
  SELECT step + 1, CASE WHEN stop THEN cells ELSE list_concat(
      list_filter(list_transform(cells, lambda c: struct_pack(now := c.now, size := c.size, origin := c.origin,
        n := c.n + CASE WHEN c.size <> fs OR c.origin <> o THEN 0 WHEN c.now = over THEN -1 WHEN c.now = under THEN 1 ELSE 0 END)), lambda c: c.n > 0),
      CASE WHEN len(list_filter(cells, lambda c: c.now = under AND c.size = fs AND c.origin = o)) > 0 THEN []
        ELSE [struct_pack(now := under, size := fs, origin := o, n := CAST(1 AS BIGINT))] END) END, aim, stop
  FROM (SELECT *, CASE WHEN list_contains(origins, over) THEN over ELSE origins[1] END AS o FROM (
    SELECT *, list_transform(list_filter(cells, lambda c: c.now = over AND c.size = fs), lambda c: c.origin) AS origins FROM (
      SELECT *, list_min(list_transform(list_filter(cells, lambda c: c.now = over), lambda c: c.size)) AS fs FROM (
        SELECT *, ['train', 'val', 'test'][list_position(e, list_max(e))] AS over, ['train', 'val', 'test'][list_position(e, list_min(e))] AS under,
          list_max(e) <= 0 OR list_min(e) >= 0 AS stop FROM (
          SELECT *, list_transform([1, 2, 3], lambda i: CAST(coalesce(list_sum(list_transform(list_filter(cells, lambda c: c.now = ['train', 'val', 'test'][i]),
            lambda c: c.size * c.n)), 0) AS BIGINT) - aim[i]) AS e FROM walk WHERE NOT done AND step < {MOVES})))))""",
    ),
    ("ends", "SELECT c.now AS now, c.size AS size, c.origin AS origin, c.n AS n FROM (SELECT unnest(arg_max(cells, step)) AS c FROM walk)"),
    (
        "spans",
        """SELECT origin, size, now, coalesce(sum(n) OVER (PARTITION BY origin, size ORDER BY CASE now WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(n) OVER (PARTITION BY origin, size ORDER BY CASE now WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS b
  FROM ends WHERE now <> origin""",
    ),
    ("ranked", "SELECT *, sha256(concat(group_key, '|13')) AS digest, row_number() OVER (PARTITION BY split, size ORDER BY sha256(concat(group_key, '|13'))) - 1 AS r FROM groups"),
)


@query(
    "g2_rebalanced_groups",
    with_splits(
        """SELECT digest, ranked.size AS size, split AS before, coalesce(now, split) AS split FROM ranked
LEFT JOIN spans ON origin = split AND spans.size = ranked.size AND r >= a AND r < b""",
        *REBALANCE_PARTS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def g2_rebalanced_groups(spark, sf_dir):
    """Every group's split before and after the moves to row targets of 60, 20 and 20 per cent, a thousand moves at most."""
    before = sp.split_table(keyed(spark, sf_dir))
    total = before.agg(F.sum("size")).first()[0]
    targets = {"train": total * 6 // 10, "val": total * 2 // 10, "test": total - total * 6 // 10 - total * 2 // 10}
    after = sp.rebalance_groups(before, targets, MOVES).select(F.col("digest").alias("_d"), F.col("split").alias("_after"))
    joined = before.join(after, F.col("digest") == F.col("_d"))
    return joined.select("digest", "size", F.col("split").alias("before"), F.col("_after").alias("split"))


@query(
    "g3_disjoint_split",
    with_splits(
        """SELECT split, count(*) AS n_rows, count(DISTINCT "_label") AS classes, 0 AS leaking_groups FROM assigned GROUP BY 1"""
    ),
)
def g3_disjoint_split(spark, sf_dir):
    """The check on the real split: it raises if a group is in two splits or a split lacks a class."""
    rows = keyed(spark, sf_dir)
    splits = tb.materialize(sp.stratified_group_split(rows), "splits")
    sp.assert_disjoint(rows, splits)
    leaking = sp.leaking_groups(splits).count()
    joined = rows.select("row_id", "_label").join(splits.select("row_id", "split"), "row_id")
    per_class = joined.groupBy("split", "_label").agg(F.count("*").alias("n"))
    return per_class.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("classes")).withColumn("leaking_groups", F.lit(leaking))


@query(
    "g3_leaking_groups",
    """SELECT source, min(fold) AS a, max(fold) AS b FROM (
  SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS fold FROM documents)
GROUP BY source HAVING count(DISTINCT fold) > 1""",
)
def g3_leaking_groups(spark, sf_dir):
    """A split by row instead of by source leaks; the check finds the sources concerned."""
    docs = table(spark, sf_dir, "documents")
    by_row = docs.select("source", F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test").alias("split"))
    return sp.leaking_groups(by_row, "source")


@query(
    "g4_stratified_kfold",
    with_telemetry(
        """SELECT row_id, "_label", CAST((row_number() OVER (PARTITION BY "_label"
  ORDER BY sha256(concat(row_id, '|13'))) - 1) % 5 AS INTEGER) AS fold FROM telemetry"""
    ),
)
def g4_stratified_kfold(spark, sf_dir):
    return sp.stratified_kfold(telemetry(spark, sf_dir).select("row_id", "_label"))


@query(
    "e2_split_report",
    with_splits(
        """SELECT split, count(*) AS n_rows, CAST(sum("_label") AS BIGINT) AS malicious,
  count(*) - CAST(sum("_label") AS BIGINT) AS benign, round(CAST(sum("_label") AS DOUBLE) / count(*), 6) AS malicious_ratio,
  count(DISTINCT group_key) AS n_groups FROM assigned GROUP BY 1"""
    ),
)
def e2_split_report(spark, sf_dir):
    return rounded(sp.split_report(sp.split_table(keyed(spark, sf_dir))), ["malicious_ratio"])


@query("d1_select_split", with_splits("SELECT row_id FROM assigned WHERE split = 'test'"))
def d1_select_split(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return sp.select_split(rows, sp.stratified_group_split(rows), "test", check=False).select("row_id")


@query("d2_ids_for_groups", with_splits("SELECT row_id FROM assigned WHERE split = 'val'"))
def d2_ids_for_groups(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return sp.ids_for(rows, sp.digest_groups(rows).where("split = 'val'"))


@query(
    "a5_split_artifact",
    with_splits("SELECT row_id, group_key, split, 0.62e0 AS train_ratio, 0.14e0 AS val_ratio, 0.24e0 AS test_ratio, 13 AS seed FROM assigned"),
)
def a5_split_artifact(spark, sf_dir):
    path = scratch_path(spark, "splits")
    tb.write_splits(sp.stratified_group_split(keyed(spark, sf_dir)), path, sp.RATIOS, 13)
    manifest = tb.read_manifest(spark, path).first()
    ratios = zip(("train_ratio", "val_ratio", "test_ratio"), manifest["ratios"], strict=True)
    saved = tb.read_splits(spark, path).select("row_id", "group_key", "split")
    return saved.withColumns({**{name: F.lit(x) for name, x in ratios}, "seed": F.lit(manifest["seed"])})


@query(
    "e3_top_groups",
    with_splits("SELECT group_key, count(*) AS n_rows FROM keyed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
)
def e3_top_groups(spark, sf_dir):
    return pf.top_groups(keyed(spark, sf_dir))


@query(
    "e4_data_overview",
    with_telemetry(
        """SELECT count(*) AS total_rows, count(*) FILTER (WHERE "_label" = 1) AS malicious_rows,
  count(*) FILTER (WHERE "_label" = 0) AS benign_rows, round(avg("_label"), 6) AS malicious_ratio FROM telemetry"""
    ),
)
def e4_data_overview(spark, sf_dir):
    return rounded(pf.data_overview(telemetry(spark, sf_dir)), ["malicious_ratio"])


@query(
    "e5_top_images",
    with_telemetry("""SELECT lower("SourceImage") AS image, count(*) AS n_rows FROM telemetry GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
)
def e5_top_images(spark, sf_dir):
    return pf.top_images(telemetry(spark, sf_dir))


@query(
    "e6_label_crosstab",
    with_telemetry(
        """SELECT CAST("_label" AS VARCHAR) AS "_label", count(*) FILTER (WHERE lower(verdict_label) = 'malicious') AS malicious,
  count(*) FILTER (WHERE lower(verdict_label) = 'benign') AS benign, count(*) FILTER (WHERE lower(verdict_label) = 'unsure') AS unsure
FROM telemetry GROUP BY 1"""
    ),
)
def e6_label_crosstab(spark, sf_dir):
    return pf.label_crosstab(telemetry(spark, sf_dir), "_label", "verdict_label", ["malicious", "benign", "unsure"])


@query(
    "e7_top_images_by_label",
    with_telemetry(
        """SELECT image, CAST(coalesce(sum(n) FILTER (WHERE "_label" = 0), 0) AS BIGINT) AS "0",
  CAST(coalesce(sum(n) FILTER (WHERE "_label" = 1), 0) AS BIGINT) AS "1" FROM (
  SELECT "_label", lower("SourceImage") AS image, count(*) AS n,
    row_number() OVER (PARTITION BY "_label" ORDER BY count(*) DESC, lower("SourceImage")) AS r
  FROM telemetry GROUP BY 1, 2) WHERE r <= 5 GROUP BY image"""
    ),
)
def e7_top_images_by_label(spark, sf_dir):
    return pf.top_images_by_label(telemetry(spark, sf_dir), "_label", [0, 1])


@query(
    "e8_length_distribution",
    """SELECT lang, min(length(text)) AS min_len, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.5) AS median,
  quantile_cont(length(text), 0.75) AS q3, max(length(text)) AS max_len, count(*) AS n_rows FROM documents GROUP BY lang""",
)
def e8_length_distribution(spark, sf_dir):
    return pf.length_distribution(table(spark, sf_dir, "documents"), "lang", F.length("text").cast("bigint"))


@query(
    "e9_majority_label",
    with_telemetry('SELECT "_label" AS majority_label FROM telemetry GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1'),
)
def e9_majority_label(spark, sf_dir):
    return pf.majority_label(telemetry(spark, sf_dir))


MINED_FLAGS = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{f}' AS feature, any_value(base) AS base_rate, count(*) FILTER (WHERE {f} > 0.5e0) AS support,
  coalesce(avg("_label") FILTER (WHERE {f} > 0.5e0), 0e0) AS rate FROM features, (SELECT avg("_label") AS base FROM features)"""
        for i, f in enumerate(rl.RULE_FLAGS)
    )
    + ") WHERE support >= 3 AND rate >= greatest(base_rate + 0.25e0, 0.7e0)"
)
MINED_NUMERICS = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{f}' AS feature, quantile_cont({f}, 0.75) FILTER (WHERE "_label" = 1) AS threshold,
  quantile_cont({f}, 0.9) FILTER (WHERE "_label" = 0) AS benign_p90 FROM features"""
        for i, f in enumerate(rl.RULE_NUMERICS)
    )
    + ") WHERE threshold > benign_p90"
)
MINED_CATEGORIES = """SELECT 0 AS ordinal, 'source_image_base' AS feature, source_image_base AS category, count(*) AS support,
  avg("_label") AS rate FROM features GROUP BY 3 HAVING count(*) >= 3 AND avg("_label") >= 0.8e0"""
MINED = (("mined_flags", MINED_FLAGS), ("mined_numerics", MINED_NUMERICS), ("mined_categories", MINED_CATEGORIES))


def features(spark, sf_dir):
    return build_features(telemetry(spark, sf_dir))


@query(
    "e10_mine_boolean_rules",
    with_features(
        "SELECT ordinal, feature, support, round(rate, 6) AS rate, round(base_rate, 6) AS base_rate FROM mined_flags", MINED[0]
    ),
)
def e10_mine_boolean_rules(spark, sf_dir):
    return rounded(rl.mine_boolean_rules(features(spark, sf_dir)), ["rate", "base_rate"])


@query("e11_mine_numeric_rules", with_features("SELECT * FROM mined_numerics", MINED[1]))
def e11_mine_numeric_rules(spark, sf_dir):
    return rl.mine_numeric_rules(features(spark, sf_dir))


@query(
    "e8_amount_quartiles",
    """SELECT l_returnflag, round(min(l_extendedprice), 6) AS min_len, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(max(l_extendedprice), 6) AS max_len, count(*) AS n_rows FROM (
  SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) / (1e0 + l_orderkey) AS l_extendedprice FROM lineitem) GROUP BY l_returnflag""",
)
def e8_amount_quartiles(spark, sf_dir):
    """Fractions that nearly all differ, by rank selection."""
    rows = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice", "l_orderkey"])
    amount = F.col("l_extendedprice").cast("double") / (1e0 + F.col("l_orderkey"))
    return rounded(pf.length_distribution(rows, "l_returnflag", amount), ["min_len", "q1", "median", "q3", "max_len"])


@query(
    "e11_rules_of_fractions",
    """SELECT ordinal, feature, round(hi, 6) AS threshold, round(lo, 6) AS benign_p90 FROM (
  SELECT 0 AS ordinal, 'price' AS feature, quantile_cont(price, 0.75) FILTER (y = 1) AS hi, quantile_cont(price, 0.9) FILTER (y = 0) AS lo FROM x
  UNION ALL SELECT 1, 'unit', quantile_cont(unit, 0.75) FILTER (y = 1), quantile_cont(unit, 0.9) FILTER (y = 0) FROM x
  UNION ALL SELECT 2, 'quantity', quantile_cont(quantity, 0.75) FILTER (y = 1), quantile_cont(quantity, 0.9) FILTER (y = 0) FROM x) WHERE hi > lo""".replace(
        " FROM x", """ FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS price, l_extendedprice / CAST(l_quantity AS DOUBLE) AS unit, CAST(l_quantity AS BIGINT) AS quantity,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem)"""
    ),
)
def e11_rules_of_fractions(spark, sf_dir):
    """Threshold rules over prices, whose quantiles are found by rank, and over a count."""
    rows = table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_quantity"]).select(
        F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity").cast("double")).cast("double").alias("unit"),
        F.col("l_quantity").cast("bigint").alias("quantity"), (F.col("l_quantity") > 25).cast("int").alias("y"),
    )
    return rounded(rl.mine_numeric_rules(rows, ["price", "unit", "quantity"], "y"), ["threshold", "benign_p90"])


@query(
    "e12_mine_category_rules",
    with_features("SELECT ordinal, feature, category, support, round(rate, 6) AS rate FROM mined_categories", MINED[2]),
)
def e12_mine_category_rules(spark, sf_dir):
    return rounded(rl.mine_category_rules(features(spark, sf_dir)), ["rate"])


@query(
    "a11_rule_round_trip",
    with_features(
        """SELECT name, kind, feature, threshold, categories FROM (
  SELECT ordinal, feature AS name, 'bool' AS kind, feature, NULL::DOUBLE AS threshold, NULL AS categories FROM mined_flags
  UNION ALL SELECT 20 + ordinal, concat('high_', feature), 'numeric', feature, threshold, NULL FROM mined_numerics
  UNION ALL SELECT 30, 'hot_source_image_base', 'category', 'source_image_base', NULL,
    string_agg(category, ',' ORDER BY category) FROM mined_categories)""",
        *MINED,
    ),
)
def a11_rule_round_trip(spark, sf_dir):
    path = scratch_path(spark, "rules")
    tb.write_rules(rl.rules_with_categories(*rl.mine_rules(features(spark, sf_dir))), path)
    saved = tb.read_rules(spark, path)
    return saved.select("name", "kind", "feature", "threshold", F.array_join("categories", ",").alias("categories"))


@query(
    "h2_apply_mined_rules",
    with_features(
        "SELECT row_id, CASE WHEN fired <> '' THEN 1 ELSE 0 END AS rule_label, fired FROM (SELECT row_id, concat_ws(',', "
        + ", ".join(
            f"CASE WHEN {f} <> 0 AND '{f}' IN (SELECT feature FROM mined_flags) THEN '{f}' END" for f in rl.RULE_FLAGS
        )
        + ", "
        + ", ".join(
            f"CASE WHEN {f} >= (SELECT threshold FROM mined_numerics WHERE feature = '{f}') THEN 'high_{f}' END"
            for f in rl.RULE_NUMERICS
        )
        + """, CASE WHEN source_image_base IN (SELECT category FROM mined_categories) THEN 'hot_source_image_base' END) AS fired
  FROM features)""",
        *MINED,
    ),
)
def h2_apply_mined_rules(spark, sf_dir):
    table_ = features(spark, sf_dir)
    out = rl.apply_rules(table_, *rl.mine_rules(table_))
    return out.select("row_id", "rule_label", F.array_join("fired_rules", ",").alias("fired"))


# Three rules with fixed parameters, in the exchange form of a rule set.
FIXED_RULES = [
    (0, "has_encodedcommand", "bool", "has_encodedcommand", None, None),
    (1, "high_cmd_length", "numeric", "cmd_length", 60.0, None),
    (2, "hot_source_image_base", "category", "source_image_base", None, ["certutil.exe", "mshta.exe"]),
]


@query(
    "flagship_rules_by_split",
    with_telemetry(
        f"SELECT model AS split, n, support_0, support_1, {rounded_sql(REPORT_COLUMNS)} FROM report",
        ("keyed", KEYED),
        ("stats", STATS),
        ("groups", GROUPS),
        ("features", feature_sql("keyed", '"CommandLine"', '"SourceImage"', "*")),
        (
            "confusion",
            """SELECT split AS model, count(*) FILTER (WHERE hit AND "_label" = 1) AS tp, count(*) FILTER (WHERE hit AND "_label" = 0) AS fp,
  count(*) FILTER (WHERE NOT hit AND "_label" = 0) AS tn, count(*) FILTER (WHERE NOT hit AND "_label" = 1) AS fn
FROM (SELECT *, has_encodedcommand = 1 OR cmd_length >= 60 OR source_image_base IN ('certutil.exe', 'mshta.exe') AS hit
  FROM features JOIN (SELECT group_key, split FROM groups) USING (group_key)) GROUP BY 1""",
        ),
        ("report", REPORT),
    ),
)
def flagship_rules_by_split(spark, sf_dir):
    """Group keys, splits, features, rules and their report in one plan."""
    rows = keyed(spark, sf_dir)
    groups = sp.split_table(rows)
    rules = spark.createDataFrame(FIXED_RULES, tb.RULE_SCHEMA)
    flagged = rl.apply_rules(build_features(rows), rules, rl.categories_of(rules))
    joined = sp.with_split(flagged.select("row_id", "group_key", "_label", "rule_label"), groups)
    counts = m.confusion_counts(joined, ["split"], prediction=F.col("rule_label"))
    report = rounded(m.classification_report(counts), REPORT_COLUMNS)
    return report.select("split", "n", "support_0", "support_1", *REPORT_COLUMNS)


@query(
    "h1_predict_majority",
    """WITH counted AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, quality, (SELECT quality FROM counted ORDER BY n DESC, quality LIMIT 1) AS prediction FROM labels""",
)
def h1_predict_majority(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    majority = pf.majority_label(labels, "quality").first()[0]
    return rl.predict_majority(labels, majority)


@query(
    "h1_majority_report",
    """WITH scored AS (SELECT 1 AS model, quality AS "_label", quality_mode AS hit FROM labels,
  (SELECT quality AS quality_mode FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
confusion AS (SELECT model, count(*) FILTER (WHERE hit = 1 AND "_label" = 1) AS tp, count(*) FILTER (WHERE hit = 1 AND "_label" = 0) AS fp,
  count(*) FILTER (WHERE hit = 0 AND "_label" = 0) AS tn, count(*) FILTER (WHERE hit = 0 AND "_label" = 1) AS fn FROM scored GROUP BY 1),
report AS ("""
    + REPORT
    + f") SELECT n, support_0, support_1, {rounded_sql(REPORT_COLUMNS)} FROM report",
)
def h1_majority_report(spark, sf_dir):
    predicted = h1_predict_majority(spark, sf_dir)
    counts = m.confusion_counts(predicted, prediction=F.col("prediction"), label="quality")
    report = rounded(m.classification_report(counts), REPORT_COLUMNS)
    return report.select("n", "support_0", "support_1", *REPORT_COLUMNS)

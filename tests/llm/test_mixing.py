import math
import random

import pytest
from pyspark.sql import functions as F

from cmdprism.llm import mixing
from cmdprism.llm.queries import QUERIES


def weights_at(tokens, a):
    total = sum(tokens.values())
    raw = {k: (t / total) ** a for k, t in tokens.items()}
    return {k: x / sum(raw.values()) for k, x in raw.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values() if w)


def made_up(spark):
    sizes = {"big": 600, "mid": 150, "low": 30, None: 12}
    rows = [(1000 * k + i, " ".join(["w"] * (5 + i % 7)), s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(9001, None, "big", "x"), (9002, "", "mid", "x"), (9003, "  ", "blank", "x"), (None, "a b c", "low", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def tokens_of(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + len((r["text"] or "").split())
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("target,limit", [(0.9, 50.0), (0.97, 2.0), (0.2, 4.0)])
def test_weights_meet_the_target_or_the_limit(spark, target, limit):
    df = made_up(spark)
    rows = df.collect()
    tokens = tokens_of(rows)
    mixed = mixing.mix(df, target_entropy=target, max_epochs=limit, block_rows=16).collect()
    used = {}
    for r in mixed:
        used[r["source"]] = used.get(r["source"], 0) + r["n_tokens"]
    top = max(tokens.values())
    # The exponent by plain bisection.
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights_at(tokens, mid)) >= target * math.log(len(tokens)) else (low, mid)
    a = low if entropy(weights_at(tokens, 1.0)) < target * math.log(len(tokens)) else 1.0
    least = min(tokens.values())
    a = max(a, 1 - math.log(limit) / math.log(top / least))
    for source, have in tokens.items():
        budget = round(top * (have / top) ** a)
        assert budget - 12 <= used[source] <= budget + 1
        assert used[source] <= limit * have + 1


def test_every_document_is_used_and_epochs_are_whole(spark):
    df = made_up(spark)
    rows = df.collect()
    mixed = mixing.mix(df, target_entropy=0.97, max_epochs=4.0, block_rows=16).collect()
    copies = {}
    for r in mixed:
        copies.setdefault(r["doc_id"], set()).add(r["epoch"])
    assert set(copies) == {r["doc_id"] for r in rows}
    assert len(mixed) == sum(len(x) for x in copies.values())
    assert all(x == set(range(len(x))) for x in copies.values())
    assert max(len(x) for x in copies.values()) <= 5
    # The last epoch holds a prefix of the order of blocks and rows, whose tokens fit.
    low = sorted((r for r in mixed if r["source"] == "mid"), key=lambda r: (r["epoch"], r["block_order"], r["block"], r["row_order"]))
    last = low[-1]["epoch"]
    order = {r["doc_id"]: i for i, r in enumerate(r for r in low if r["epoch"] == last)}
    assert len(order) < len({r["doc_id"] for r in low})
    assert len({r["block"] for r in low}) > 5


def test_a_set_budget_drops_what_does_not_fit(spark):
    df = made_up(spark)
    mixed = mixing.mix(df, budget=800, block_rows=16).collect()
    assert 0.9 * 800 <= sum(r["n_tokens"] for r in mixed) <= 801


def test_query_over_the_table(spark, sf_dir):
    df = QUERIES["op8_temperature_mix"](spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in df.collect()} == docs


def test_empty_table_and_single_source(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    one = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert [r["epoch"] for r in mixing.mix(one).collect()] == [0, 0]
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert len(mixing.mix(none).collect()) == 1


def test_clashing_columns_are_kept(spark):
    rows = [(i, f"wort {i} text", f"s{i % 3}", f"own {i}", i, -i, f"b{i}", "t") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source string, _tokens long, _block int, _row string, block string")
    out = mixing.mix(df)
    assert {c for c in df.columns if c != "block"} <= set(out.columns)
    got = {(r["doc_id"], r["_source"], r["_tokens"], r["_block"], r["_row"]) for r in out.collect()}
    assert got == {(r[0], r[3], r[4], r[5], r[6]) for r in rows}


def test_the_last_epoch_is_the_exact_prefix_of_the_block_permutation(spark):
    """Blocks by their hash for the epoch, documents by theirs: taken as long as their tokens, added up, fit the rest of the budget."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) + f" x{i}", f"s{0 if i % 3 else 1 + i % 7}") for i in range(700)]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, block_rows=16)
    got = [r.asDict() for r in out.collect()]
    staged = df.select(mixing.source_name(F.col("source")).alias("_source"), mixing.token_count(F.col("text")).alias("_tokens"))
    budgets = {r["_source"]: (r["tokens"], r["budget"]) for r in mixing.source_budgets(staged, mixing.TARGET_ENTROPY, mixing.MAX_EPOCHS, None)[0].collect()}
    blocks = -(-len(rows) // 16)
    last = 0
    for name, (tokens, budget) in budgets.items():
        own = [r for r in rows if f"s:{r[2]}" == name]
        whole = budget // tokens
        keys = spark.createDataFrame(own, df.schema).select(
            "doc_id", "text",
            F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), F.lit(blocks)).cast("long").alias("block"),
            F.xxhash64(F.lit(mixing.SEED + 1), "doc_id", "text").alias("row"),
        ).withColumn("order", F.xxhash64(F.lit(mixing.SEED + 2), F.lit(whole).cast("long"), F.lit(name), "block"))
        ordered = sorted(keys.collect(), key=lambda r: (r["order"], r["block"], r["row"], r["doc_id"]))
        taken, total = [], 0
        for r in ordered:
            total += len(r["text"].split())
            if total <= budget - whole * tokens:
                taken.append(r["doc_id"])
        mine = [r for r in got if f"s:{r['source']}" == name]
        for epoch in range(whole):
            assert sorted(r["doc_id"] for r in mine if r["epoch"] == epoch) == sorted(r[0] for r in own)
        assert sorted(r["doc_id"] for r in mine if r["epoch"] == whole) == sorted(taken)
        assert max((r["epoch"] for r in mine), default=0) <= whole
        last += len(taken)
    assert last > 10

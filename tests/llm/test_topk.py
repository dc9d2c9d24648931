import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdprism.llm import topk
from cmdprism.llm.queries import QUERIES


def plain(rows, k, step, scale=256):
    """Every row but the query's own is a candidate, whatever its id."""
    kept = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for at, (q, a) in enumerate(kept):
        if q % step:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for j, (i, b) in enumerate(kept) if j != at and len(b) == len(a))
        out += [(q, rank, i, max(-(2**63), min(-s, 2**63 - 1))) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def answer(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("width", [3, 16])
@pytest.mark.parametrize("seed_rows", [4, 5000])
def test_equal_to_all_products(spark, width, seed_rows):
    rng = np.random.default_rng(width)
    rows = [(i, [float(x) for x in rng.normal(size=width) * (1 + (i % 7 == 0) * 3)]) for i in range(400)]
    rows += [(1000 + i, rows[10][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2002, []), (2004, [float("nan")] * width), (2006, [None] * width), (2008, [float("inf")] * width)]
    rows += [(2010, [0.0] * width), (2012, [1.0]), (2014, [2.0]), (None, [1.0] * width)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    every = F.pmod("id", F.lit(2)) == 0
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block in (1 << 26, 50 * 16 * width):
        got = topk.top_k(df, every, k=7, seed_rows=seed_rows, query_bytes=block)
        assert answer(got) == plain(as_float, 7, 2)


def test_query_over_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert answer(QUERIES["op10_exact_top_k"](spark, sf_dir)) == plain(rows, 5, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.pmod("id", F.lit(2)) == 0).collect() == []


def test_query_rows_that_share_an_id_have_their_own_lists(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, size=4)]) for i in [*range(40), 2, 2, 4, 7]]
    rows += [rows[6], rows[6]]  # equal rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1 << 26, 3 * 64):
        assert answer(topk.top_k(df, F.pmod("id", F.lit(2)) == 0, scale=1, query_bytes=block)) == plain(rows, 5, 2, 1)


def test_a_row_with_the_query_s_id_is_a_candidate(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [5.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    found = answer(topk.top_k(df, F.col("id") == 0, scale=1))
    assert found == [(0, 1, 0, 5), (0, 1, 1, 10), (0, 2, 0, 5), (0, 2, 1, 2)]


def test_long_vectors_are_multiplied_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, size=3)]) for i in range(30)]
    rows += [(100 + i, [2.0**27 + i % 3, float(2**53 - 2 * i), 1.0]) for i in range(12)]  # products differ behind the 53rd bit
    rows += [(200, [1e30, -1e30, 2.0]), (202, [-1e12, 1e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert answer(topk.top_k(df, F.pmod("id", F.lit(2)) == 0, scale=1)) == plain(rows, 5, 2, 1)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdprism.llm import whitening
from cmdprism.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, v int, part int, values string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA)


def check(rows, kept, wanted=32):
    """Compare the result of rows (vec_id, vector) with a dense eigen-decomposition."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    moved = n * x - sums
    centred = (moved / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(wanted, int((e > 1e-10 * e.sum()).sum()))
    assert len(rows) == n * k and {r["n"] for r in rows} == ({n} if k else set())
    if not k:
        return
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    white = centred @ u[:, :k] / np.sqrt(e[:k])
    signs = [0.0] * k
    for (i, _), deviation, w in zip(kept, (moved * moved).sum(axis=1), white, strict=True):
        for c in range(k):
            r = by_id[i][c + 1][0]
            assert r["deviation"] == (deviation if deviation < 2**63 else None)
            assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-6) and r["identity_error"] < 1e-6
            if abs(w[c]) > 1e-3:
                signs[c] = signs[c] or np.sign(w[c] * r["whitened"])
            assert r["whitened"] == pytest.approx((signs[c] or 1.0) * w[c], abs=1e-6)


@pytest.mark.parametrize("width, n", [(5, 200), (40, 300), (12, 8)])
def test_equal_to_dense_eigenvectors(spark, width, n):
    rng = np.random.default_rng(width)
    mixed = rng.normal(size=(n, width)) * np.geomspace(3, 0.2, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    kept = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    bad = [(900, None), (901, []), (902, [None] * width), (903, [float("nan")] * width), (904, [math.inf] * width), (905, [1e30] * width)]
    rows = whitening.whiten(frame(spark, [*kept, *bad])).collect()
    check(rows, kept)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    kept = [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-(2**40), 2**40, size=(50, 4)))]
    check(whitening.whiten(frame(spark, kept)).collect(), kept)


def test_equal_eigenvalues_give_a_basis(spark):
    corners = [[a, b, c] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 1.0)]  # covariance 1024 * identity
    rows = whitening.whiten(frame(spark, list(enumerate(corners)))).collect()
    w = np.zeros((8, 3))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(1 / 3, rel=1e-9) and r["identity_error"] < 1e-9
    assert np.abs(w.T @ w / 8 - np.eye(3)).max() < 1e-9


def test_widths_and_rows_without_spread(spark):
    rng = np.random.default_rng(8)
    wide = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(30)]
    narrow = [(100 + i, [float(c) for c in rng.normal(size=2)]) for i in range(20)]
    rows = whitening.whiten(frame(spark, [*wide, *narrow, (200, [1.0])])).collect()
    check([r for r in rows if r["vec_id"] < 100], wide)
    check([r for r in rows if 100 <= r["vec_id"] < 200], narrow)
    assert all(r["vec_id"] < 200 for r in rows)
    for none in ([], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert whitening.whiten(frame(spark, none)).collect() == []


def test_repeated_and_null_ids_are_rows(spark):
    rng = np.random.default_rng(9)
    vectors = [[float(c) for c in rng.normal(size=3)] for _ in range(10)]
    rows = whitening.whiten(frame(spark, [(None if i > 7 else 4, v) for i, v in enumerate([*vectors, vectors[0]])]))
    assert {(r["vec_id"], r["component"]): r["count"] for r in rows.groupBy("vec_id", "component").count().collect()} == {
        (i, c): m for i, m in ((4, 8), (None, 3)) for c in (1, 2, 3)
    }


@pytest.mark.parametrize("width", [1, 2, 7, 30])
def test_inertia_counts_eigenvalues(width):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(width, width))
    for v in (a + a.T, a @ a.T, np.diag(np.repeat([2.0, -1.0], [width // 2, width - width // 2])), np.zeros((width, width)) + 1):
        e = np.linalg.eigvalsh(v)
        for shift in [*(e[1:] + e[:-1]) / 2, e[0] - 1, e[-1] + 1, 0.37]:
            if np.abs(e - shift).min() > 1e-9:
                assert whitening.count_above(v, shift) == (e > shift).sum()


def test_slices_hold_one_eigenvalue_each():
    a = np.random.default_rng(5).normal(size=(60, 20))
    v = a.T @ a / 60
    e = np.linalg.eigvalsh(v)[::-1]
    found = whitening.slices(v, 8)
    assert [(s.first, s.last) for s in found] == [(k, k) for k in range(1, 9)]
    assert all(s.low < e[s.first - 1] <= s.high and ((e > s.low) & (e <= s.high)).sum() == 1 for s in found)


def test_query_over_the_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kept = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    result = QUERIES["op11_whitening"](spark, sf_dir)
    assert result.where(F.col("identity_error") > 1e-4).count() == 0
    check(result.collect(), kept)

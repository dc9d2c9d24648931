"""Embedding whitening: leading eigenvalues isolated by inertia counts, then refined by Rayleigh quotient iteration.

Sums and the centred products of whole-number vectors are added up exactly in the tasks; the covariance that reaches the
driver has the size of the model (width x width), whatever the table. There, the number of positive pivots of
``V - shift = L D L'`` is the number of eigenvalues above the shift (Sylvester's law of inertia). Bisection on these counts slices
the spectrum until an interval holds one eigenvalue; Rayleigh quotient iteration then converges cubically, and counts just
above and below each result certify its number. Eigenvalues closer than doubles can separate form one slice, whose
vectors come from inverse iteration on an orthonormal block. Each row is projected in its task.

Defined results: vectors that are null, empty or hold a null, non-finite or too large component (|64 c| of 2**52 or more, where
whole numbers end) take no part. Vectors of another width are whitened with those of their own width. Components with an
eigenvalue of at most 1e-10 of the trace have no direction to scale and are left out, so equal vectors, or a single one, give
no rows. Repeated rows and repeated or null ids are rows of their own; ``deviation`` is null where it does not fit a long. An
empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
#: Eigenvalues below this share of the trace have no direction of their own.
LEAST_SHARE = 1e-10
#: Slices narrower than this share of the largest eigenvalue are not divided further.
NARROW = 1e-13
#: Partial sums of the tasks meet in so many groups first.
GROUPS = 32
#: Sums of whole numbers in doubles are exact below this.
EXACT = 2**53
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"

# ---- eigenvalues of the covariance -------------------------------------------------------------


def pivots(a: np.ndarray) -> np.ndarray:
    """Eigenvalues of the 1 x 1 and 2 x 2 blocks of D in ``a = L D L'``, with complete pivoting."""
    a = a.copy()
    out: list[float] = []
    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        largest = int(np.abs(a).argmax())
        i, j = divmod(largest, len(a))
        if diagonal[k] >= 0.6404 * abs(a[i, j]):  # (1 + sqrt(17)) / 8: bounds the growth of the entries
            d = a[k, k]
            out.append(d)
            rest = np.delete(np.arange(len(a)), k)
            column = a[rest, k]
            a = a[np.ix_(rest, rest)]
            if d != 0:
                a = a - np.outer(column, column / d)
        else:
            pair = [i, j]
            block = a[np.ix_(pair, pair)]
            middle, half = (block[0, 0] + block[1, 1]) / 2, np.hypot((block[0, 0] - block[1, 1]) / 2, block[0, 1])
            out += [middle + half, middle - half]
            rest = np.delete(np.arange(len(a)), pair)
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return np.array(out)


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` above ``shift``, by the inertia of the shifted matrix."""
    return int((pivots(v - shift * np.eye(len(v))) > 0).sum())


@dataclass
class Slice:
    """An interval (low, high] that holds the eigenvalues number ``first`` to ``last``, counted from 1 by falling value."""

    low: float
    high: float
    first: int
    last: int


def slices(v: np.ndarray, wanted: int) -> list[Slice]:
    """Intervals with one eigenvalue each, or too narrow to divide, for the leading ``wanted`` eigenvalues."""
    top = float(np.abs(v).sum(axis=1).max())
    todo = [Slice(-top * 1e-6 - np.finfo(float).tiny, top * (1 + 1e-6) + np.finfo(float).tiny, 1, len(v))]
    done = []
    while todo:
        s = todo.pop()
        if s.first > wanted:
            continue
        if s.first == s.last and s.high - s.low < top / 8 or s.high - s.low <= NARROW * top:
            done.append(s)
            continue
        middle = (s.low + s.high) / 2
        above = count_above(v, middle)
        if above >= s.first:
            todo.append(Slice(middle, s.high, s.first, min(above, s.last)))
        if above < s.last:
            todo.append(Slice(s.low, middle, max(above + 1, s.first), s.last))
    return sorted(done, key=lambda s: s.first)


def solve(v: np.ndarray, shift: float, rhs: np.ndarray) -> np.ndarray:
    """Solution for the shifted matrix; a shift that is an eigenvalue to the last bit is moved by one rounding."""
    eye = np.eye(len(v))
    for step in (0.0, 1.0, 4.0, 64.0):
        moved = shift + step * np.finfo(float).eps * max(abs(shift), np.abs(v).max())
        try:
            found = np.linalg.solve(v - moved * eye, rhs)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError(f"no solution near {shift}")


def refine(v: np.ndarray, s: Slice) -> tuple[float, np.ndarray]:
    """The slice's one eigenpair. An iteration that leaves the slice halves it and starts anew."""
    rng = np.random.default_rng(s.first)
    low, high = s.low, s.high
    start = rng.normal(size=len(v))
    scale = float(np.abs(v).sum(axis=1).max())
    while True:
        x = start
        for _ in range(2):
            x = solve(v, (low + high) / 2, x)
            x /= np.linalg.norm(x)
        rho = float(x @ v @ x)
        residual = np.inf
        for _ in range(20):
            if not low < rho <= high:
                break
            now = float(np.linalg.norm(v @ x - rho * x))
            # Converged, and no further step makes it better.
            if now <= NARROW * scale and now >= residual / 2 or now == 0:
                return rho, x
            residual = now
            x = solve(v, rho, x)
            x /= np.linalg.norm(x)
            rho = float(x @ v @ x)
        if high - low <= NARROW * scale:
            return (low + high) / 2, x
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(v, middle) >= s.first else (low, middle)


def block_of(v: np.ndarray, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal vectors for eigenvalues that doubles can't tell apart, by inverse iteration on a block."""
    x = np.random.default_rng(s.first).normal(size=(len(v), s.last - s.first + 1))
    for _ in range(4):
        x, _ = np.linalg.qr(solve(v, (s.low + s.high) / 2, x))
    return np.array([float(c @ v @ c) for c in x.T]), x


def certified(v: np.ndarray, values: np.ndarray) -> bool:
    """True where counts beside every value prove its number; values closer than the margin count together."""
    margin = 1e-9 * max(float(values[0]), np.finfo(float).tiny)
    at = np.arange(1, len(values) + 1)
    for k, e in zip(at, values, strict=True):
        if count_above(v, e + margin) > k - 1 or count_above(v, e - margin) < k:
            return False
    return True


def leading_components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance by falling value, with their unit vectors as columns.

    Values of at most LEAST_SHARE of the trace are left out.
    """
    floor = LEAST_SHARE * float(np.trace(v))
    wanted = min(wanted, count_above(v, floor)) if floor > 0 else 0
    if wanted == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = [], []
    for s in slices(v, wanted):
        found, columns = refine(v, s) if s.first == s.last else block_of(v, s)
        values.append(np.atleast_1d(found))
        vectors.append(np.reshape(columns, (len(v), -1)))
    e, x = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-e, kind="stable")[:wanted]
    if not certified(v, e[order]):
        raise ArithmeticError("inertia counts and eigenvalues disagree")
    return e[order], x[:, order]


# ---- exact sums over the table -------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of whole numbers floor(scale * c), without the rows that take no part."""
    whole = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    inside = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < 2.0**52, F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.when(inside & (F.size(vector_col) > 0), whole).alias("v"))
    return kept.where("v IS NOT NULL")


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x' x`` of whole numbers: in doubles where no sum can be rounded, else in Python's integers."""
    largest = int(np.abs(x).max()) if x.size else 0
    if largest * largest * len(x) < EXACT:
        part = x.astype(np.float64)
        return (part.T @ part).astype(np.int64).astype(object)
    part = x.astype(object)
    return part.T @ part


def summed(parts: DataFrame) -> DataFrame:
    """Rows (at, part, values) added up by ``at``, in two steps; numbers go as text, so none is rounded or too large."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, [np.array([int(t) for t in values], object) for values in rows["values"]])
        return pd.DataFrame({"at": [rows["at"].iloc[0]], "part": [0], "values": [[str(t) for t in total]]})

    schema = "at int, part int, values array<string>"
    return parts.groupBy("at", "part").applyInPandas(add, schema).groupBy("at").applyInPandas(add, schema)


def per_task(rows: DataFrame, step: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
    """Sum over all rows of ``step``, a matrix of ``height`` rows of whole numbers for a batch of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                made = step(np.stack(batch["v"].to_numpy()).astype(np.int64))
                total = made if total is None else total + made
        if total is not None:
            part = TaskContext.get().partitionId() % GROUPS
            yield pd.DataFrame({"at": np.arange(len(total)), "part": part, "values": [[str(t) for t in row] for row in total]})

    found = summed(rows.select("v").mapInPandas(run, "at int, part int, values array<string>")).collect()
    out = [None] * height
    for row in found:
        out[row["at"]] = [int(t) for t in row["values"]]
    return np.array(out, object)


def covariance(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Count, exact sums and the covariance (divisor n, centred before multiplying) of whole-number vectors.

    Vectors are centred by the nearest whole number to the mean; the fraction that is left is taken off exactly.
    """
    sums = per_task(rows, lambda x: np.array([[len(x), *x.astype(object).sum(axis=0)]], object), 1)[0]
    n, totals = int(sums[0]), [int(t) for t in sums[1:]]
    centre = [(2 * t + n) // (2 * n) for t in totals]
    middle = np.array(centre, np.int64)
    products = per_task(rows, lambda x: exact_products(x - middle), width)
    left = [t - n * c for t, c in zip(totals, centre, strict=True)]
    exact = products * n - np.outer(np.array(left, object), np.array(left, object))
    return n, totals, np.array([[int(e) / (n * n) for e in row] for row in exact])


# ---- projection --------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, totals: np.ndarray) -> tuple[np.ndarray, pd.array]:
    """Centred vectors in doubles and the exact squared length of n times them."""
    if 2 * n * max(int(np.abs(x).max()), 1) < 2**62:
        moved = n * x - totals.astype(np.int64)
        centred = moved / n
        if int(np.abs(moved).max()) ** 2 * x.shape[1] < 2**62:
            return centred, pd.array((moved * moved).sum(axis=1), dtype="Int64")
        moved = moved.astype(object)
    else:
        moved = n * x.astype(object) - totals
        centred = (moved / n).astype(np.float64)
    return centred, pd.array([int(v) if v < 2**63 else None for v in (moved * moved).sum(axis=1)], dtype="Int64")


def whitened_rows(rows: DataFrame, n: int, totals: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> DataFrame:
    """One row per vector and component."""
    sums, scaled, explained = np.array(totals, object), vectors / np.sqrt(values), values / trace

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            centred, deviation = deviations(np.stack(batch["v"].to_numpy()).astype(np.int64), n, sums)
            k = len(explained)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1), len(batch)), "n": n,
                    "deviation": deviation.repeat(k), "whitened": (centred @ scaled).ravel(), "explained": np.tile(explained, len(batch)),
                }
            )

    return rows.select("vec_id", "v").mapInPandas(run, SCHEMA)


def identity_error(rows: DataFrame, n: int, totals: list[int], values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all rows."""
    sums, scaled = np.array(totals, object), vectors / np.sqrt(values)
    k = scaled.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if len(batch):
                centred, _ = deviations(np.stack(batch["v"].to_numpy()).astype(np.int64), n, sums)
                w = centred @ scaled
                total += np.column_stack([w.T @ w, w.sum(axis=0)])
        at = np.arange(total.size)
        yield pd.DataFrame({"at": at, "value": total.ravel()})

    cells = rows.select("v").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(k * (k + 1))
    for row in cells:
        found[row["at"]] = row["value"]
    found = found.reshape(k, k + 1)
    mean = found[:, k] / n
    return float(np.abs(found[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part."""
    rows = whole_vectors(vectors, id_col, vector_col)
    out = []
    for width in sorted(r[0] for r in rows.select(F.size("v").alias("w")).distinct().collect()):
        own = rows.where(F.size("v") == width)
        n, totals, v = covariance(own, width)
        values, directions = leading_components(v, components)
        if len(values):
            error = identity_error(own, n, totals, values, directions)
            found = whitened_rows(own, n, totals, values, directions, float(np.trace(v)))
            out.append(found.withColumn("identity_error", F.lit(error)))
    if not out:
        return vectors.sparkSession.createDataFrame([], f"{SCHEMA}, identity_error double")
    return reduce(DataFrame.unionByName, out)


def op11(embeddings: DataFrame) -> DataFrame:
    """Adding 1000000 to every component changes vectors and means alike, so all results are those of the numbers without it."""
    return whiten(embeddings.select("vec_id", "embedding"))

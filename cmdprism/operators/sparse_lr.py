"""Logistic regression whose weights are a table: no vocabulary and no weight vector on the driver.

Entries (row, term, x), rows and all vectors over terms are written tables. Margins are a join of entries and weights summed
by row; a gradient is a join of entries and residuals summed by term, so a term of most rows is added up in every task first. The
solver is L-BFGS in its vector-free form: one pass in Arrow batches gives all dot products of the kept differences and the gradient, the
two loops run on these numbers, and the direction is a linear combination of columns. Margins are linear along a direction, so one
pass looks at many step lengths at once. The driver holds the dot products, the intercept and its differences. Numbers that change
from round to round reach the tasks as arrays: the plans of all rounds then share their compiled code.

The solver sees each weight times the root of its largest possible curvature (``scale``): terms of most rows and of one row then
have steps of a like size, which takes far fewer rounds. Rows of equal text are one row with their summed weight.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.operators.models import TEXT_C, with_class_weight
from cmdprism.operators.scoring import logistic
from cmdprism.operators.textmodel import fit_tfidf, term_counts, transform_tfidf, weigh_terms, with_terms
from cmdprism.session import COMMAND, LABEL
from cmdprism.sources.tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = 8
#: Rounds that ``settled`` looks at.
SETTLED_ROUNDS = 3
#: Step lengths that one aggregate looks at.
STEPS = [0.0, *(2.0**k for k in range(-8, -1)), *(k / 8 for k in range(4, 17)), 3.0, 4.0, 8.0, 16.0]


@dataclass
class TableWeights:
    """A fitted model: (term, weight) as a written table, the intercept, and how the fit ended."""

    weights: DataFrame
    intercept: float
    slope: float  # largest absolute entry of the gradient of the mean loss
    rounds: int


def _residual(margin: Column) -> Column:
    return F.col("weight") * (logistic(margin) - F.col("y"))


def _gradients(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, dg, top): derivatives of the summed loss, and the most that its second derivatives can be."""
    residuals = rows.select("row", _residual(F.col("z")).alias("r"), (F.col("weight") / 4).alias("most"))
    sums = F.sum(F.col("x") * F.col("r")).alias("dg"), F.sum(F.col("x") * F.col("x") * F.col("most")).alias("top")
    return entries.join(residuals, "row").groupBy("term").agg(*sums)


def direction(dots: np.ndarray) -> np.ndarray:
    """Coefficients of the direction over (s_1.., y_1.., g), newest difference first, from all their dot products."""
    m = (len(dots) - 1) // 2
    out = np.zeros(2 * m + 1)
    out[-1] = -1.0
    alpha = np.zeros(m)
    for i in range(m):
        alpha[i] = (dots[i] @ out) / dots[i, m + i]
        out[m + i] -= alpha[i]
    if m:
        out *= dots[0, m] / dots[m, m]
    for i in range(m - 1, -1, -1):
        out[i] += alpha[i] - (dots[m + i] @ out) / dots[i, m + i]
    return out


def combine(columns: list[Column], factors: list[float]) -> Column:
    """The sum of columns times numbers, whose code does not depend on the numbers."""
    products = F.zip_with(F.array(*columns), F.lit([float(x) for x in factors]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def _summed(batches: Iterator[pa.RecordBatch], sums_of) -> Iterator[pa.RecordBatch]:
    """One row with the sums that ``sums_of`` gives per batch; their last number is a maximum."""
    total = None
    for batch in batches:
        if batch.num_rows:
            found = sums_of(batch)
            total = found if total is None else np.append(total[:-1] + found[:-1], max(total[-1], found[-1]))
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def totals(df: DataFrame, sums_of, width: int) -> np.ndarray:
    """Sums over all rows, and the maximum, of a function from a batch to an array of ``width`` numbers."""
    parts = df.mapInArrow(lambda batches: _summed(batches, sums_of), "sums array<double>").collect()
    found = np.array([p["sums"] for p in parts]).reshape(-1, width)
    return np.append(found[:, :-1].sum(axis=0), found[:, -1].max(initial=0.0))


def dots_of(kept: int):
    """Per batch of the state: dot products of the basis, those over the squared scale, its products with the weights, the steepest slope."""

    def sums_of(batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        scale, w, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scale", "w", "g"))
        s, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, kept) for c in ("s", "y"))
        basis = np.column_stack([s, y, g / scale])
        own = basis / scale[:, None]
        return np.concatenate([(basis.T @ basis).ravel(), (own.T @ own).ravel(), own.T @ w, [np.abs(g).max()]])

    return sums_of


def slopes_of(batch: pa.RecordBatch) -> np.ndarray:
    """Per batch of the moves: for every step length the residuals' product with the move and their sum."""
    z, dz, y, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "dz", "y", "weight"))
    with np.errstate(over="ignore"):
        residuals = [weight * (1.0 / (1.0 + np.exp(-(z + a * dz))) - y) for a in STEPS]
    return np.array([*[dz @ r for r in residuals], *[r.sum() for r in residuals], 0.0])


def fit(
    entries: DataFrame, labels: DataFrame, c: float = TEXT_C, max_rounds: int = 200, tolerance: float = 1e-7, memory: int = MEMORY,
    n_rows: int | None = None, settled: float = 0.0,
) -> TableWeights:
    """Minimise ``sum weight * log loss + |w|^2 / (2 c)``; the intercept is not penalised.

    ``entries`` (row, term, x) and ``labels`` (row, y, weight) are written tables, one row per row and term. Rows without
    entries have the intercept as margin. Ends when no derivative of the mean loss exceeds ``tolerance``. Where a row stands for
    several, ``y`` is the mean of theirs by weight and ``weight`` their sum; ``n_rows`` is then how many there are in all. Ends also when
    each of SETTLED_ROUNDS rounds took less than ``settled`` of the first loss off it.
    """
    n = labels.count() if n_rows is None else n_rows
    if not n:
        raise ValueError("no labeled rows available")
    rows = labels.select("row", F.col("y").cast("double").alias("y"), "weight", F.lit(0.0).alias("z"))
    scale = F.sqrt(F.col("top") + 1.0 / c).alias("scale")
    start = _gradients(entries, rows).select("term", scale, F.lit(0.0).alias("w"), F.col("dg").alias("g"))
    nothing = F.array().cast("array<double>")
    state = materialize(start.withColumns({"s": nothing, "y": nothing}), "lr-state")
    b, held_s, held_y = 0.0, [], []
    gb, top, whole = rows.agg(F.sum(_residual(F.col("z"))), F.sum(F.col("weight") / 4), F.sum("weight")).first()
    first_loss, drops = whole * float(np.log(2.0)), []
    own_scale = np.sqrt(top) or 1.0
    slope, rounds = np.inf, 0
    while True:
        m = len(held_s)
        size = 2 * m + 1
        found = totals(state.select("scale", "w", "g", "s", "y"), dots_of(m), 2 * size * size + size + 1)
        dots, own_dots = found[: 2 * size * size].reshape(2, size, size)
        slope = max(found[-1], abs(gb)) / n
        if slope <= tolerance or rounds >= max_rounds or len(drops) >= SETTLED_ROUNDS and max(drops[-SETTLED_ROUNDS:]) < settled * first_loss:
            break
        own = np.array([*held_s, *held_y, gb / own_scale])
        weights = direction(dots + np.outer(own, own))
        basis = [*[F.col("s")[i] for i in range(m)], *[F.col("y")[i] for i in range(m)], F.col("g") / F.col("scale")]
        d = combine(basis, weights) / F.col("scale")
        db = float(own @ weights) / own_scale
        dw, dd = float(found[-size - 1 : -1] @ weights), float(weights @ own_dots @ weights)
        moves = entries.join(state.select("term", d.alias("d")), "term").groupBy("row").agg(F.sum(F.col("x") * F.col("d")).alias("m"))
        shifted = combine([F.coalesce("m", F.lit(0.0)), F.lit(1.0)], [1.0, db])
        moved = materialize(rows.join(moves, "row", "left").select("row", "y", "weight", "z", shifted.alias("dz")), "lr-moves")
        sums = totals(moved.select("z", "dz", "y", "weight"), slopes_of, 2 * len(STEPS) + 1)
        # d . (w + a d) / c is the penalty's derivative along the direction, which the intercept has no part in.
        slopes = [sums[i] + (dw + a * dd) / c for i, a in enumerate(STEPS)]
        if slopes[0] >= 0:
            break  # no descent left within doubles
        # The derivative rises from below zero (the loss is convex): the step where it is flattest.
        best = min(range(1, len(STEPS)), key=lambda i: abs(slopes[i]))
        a, new_gb = STEPS[best], sums[len(STEPS) + best]
        # The loss is convex along the step: what its derivatives at the steps before give by trapezoids is what it falls by.
        drops.append(-sum((slopes[i] + slopes[i + 1]) / 2 * (STEPS[i + 1] - STEPS[i]) for i in range(best)))
        rows = moved.select("row", "y", "weight", combine([F.col("z"), F.col("dz")], [1.0, a]).alias("z"))
        step = combine([d], [a])
        after = F.coalesce("dg", F.lit(0.0)) + (F.col("w") + step) / c
        joined = state.join(_gradients(entries, rows), "term", "left")
        state = materialize(
            joined.select(
                "term", "scale", (F.col("w") + step).alias("w"), after.alias("g"),
                F.slice(F.concat(F.array(step * F.col("scale")), "s"), 1, memory).alias("s"),
                F.slice(F.concat(F.array((after - F.col("g")) / F.col("scale")), "y"), 1, memory).alias("y"),
            ),
            "lr-state",
        )
        held_s, held_y = [a * db * own_scale, *held_s][:memory], [(new_gb - gb) / own_scale, *held_y][:memory]
        b, gb, rounds = b + a * db, new_gb, rounds + 1
    return TableWeights(state.select("term", F.col("w").alias("weight")), b, slope, rounds)


@dataclass
class TextWeights:
    """TF-IDF vocabulary and weights as one written table (term, df, corpus_tf, idf, weight), and how texts are scored with them."""

    vocabulary: DataFrame
    intercept: float
    accents: bool = True
    model: TableWeights | None = None

    def score(self, df: DataFrame, out: str = "prob_text", text: str = COMMAND) -> DataFrame:
        """Add the probability of class 1. Equal texts are weighed once and meet their rows by a digest, so rows need no key. Terms outside
        the vocabulary don't count."""
        digest = F.sha2(F.col(text), 256)
        texts = with_terms(df.select(F.col(text).alias("_text")).distinct(), "_text", accents=self.accents)
        counts = term_counts(texts.withColumn("_of", F.sha2("_text", 256)), "_of")
        entries = weigh_terms(counts, self.vocabulary, "_of", ("weight",), "_x")
        norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")))
        margins = entries.groupBy("_of").agg((F.sum(F.col("_x") * F.col("weight")) / norm).alias("_m"))
        joined = df.withColumn("_digest", digest).join(margins, F.col("_digest") == F.col("_of"), "left")
        margin = F.coalesce("_m", F.lit(0.0)) + self.intercept
        return joined.withColumn(out, logistic(margin)).select(*df.columns, out)


def train_text_table(
    train: DataFrame, min_df: int = 1, c: float = TEXT_C, max_rounds: int = 200, tolerance: float = 1e-6, text: str = COMMAND,
    max_features: int | None = None, settled: float = 0.0,
) -> TextWeights:
    """Balanced regression over TF-IDF terms of any number; rows of equal text go as one. Terms have numbers while weights are sought."""
    weighted = with_class_weight(train.where(F.col(LABEL).isNotNull()).select(text, LABEL))
    weight = F.sum("weight")
    merged = weighted.groupBy(text).agg(
        F.count("*").alias("n"), weight.alias("weight"), (F.sum(F.col("weight") * F.col(LABEL)) / weight).alias("y")
    )
    labels = materialize(merged.withColumn("row", F.monotonically_increasing_id()), "lr-labels")
    n_rows = labels.agg(F.sum("n")).first()[0] or 0
    counts = materialize(term_counts(with_terms(labels, text), "row", ("n",)), "term-counts")
    fitted = fit_tfidf(counts, n_rows, min_df, max_features, times="n")
    vocabulary = materialize(fitted.withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    entries = transform_tfidf(counts, vocabulary, "row", ("number",)).select("row", F.col("number").alias("term"), F.col("tfidf").alias("x"))
    model = fit(materialize(entries, "lr-entries"), labels.select("row", "y", "weight"), c, max_rounds, tolerance, n_rows=n_rows, settled=settled)
    weights = vocabulary.join(model.weights.withColumnRenamed("term", "number"), "number").drop("number")
    return TextWeights(materialize(weights, "text-weights"), model.intercept, model=model)

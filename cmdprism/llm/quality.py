"""Quality by ordinal cumulative-link regression on graded ratings.

With ordered grades 0 to K, P(grade <= k) = sigmoid(threshold_k - score), one score for all grades: a sum of weights of hashed
words and of word shapes (letters, capitals, digits and signs, with runs shortened). Thresholds stay ordered because each
is the one before plus the exponential of a free number. Weights and thresholds are fitted together by L-BFGS on the
whole fitting sample; each step's loss and gradient are sums over tasks.

A document gets its expected grade and the probability of at least the wanted grade, by which it is kept.

Defined results: null and empty texts have no features, so their score is 0. A rating without a text takes no part; several
ratings of one id count as their lowest; rows that repeat an id are rated alike. With no ratings, or with one grade only,
that grade (0 without any) is certain. Empty tables give no rows; extra columns take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import crc_bucket, hash_share
from cmdprism.sources.tables import materialize

#: The regression is fitted on about this many rated documents, chosen by a hash of the id.
FIT_ROWS = 20_000
#: Tasks that the sample is dealt to.
FIT_TASKS = 16
BUCKETS = 1 << 15
ROUNDS = 30
RIDGE = 1e-3
#: A document is kept if it reaches this grade with at least this probability.
KEEP_GRADE, KEEP_TAIL = 1, 0.5

#: Letters in lower case; everything but letters, digits and bytes from 0x80 parts words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: a letters, A capitals, 9 digits, white space parts shapes, signs stay.
SHAPE_BYTES = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else 0x20 if b <= 0x20 else b
    for b in range(256)
)


def shapes(raw: bytes) -> list[bytes]:
    """Word shapes with runs of one character shortened to one."""
    kinds = np.frombuffer(raw.translate(SHAPE_BYTES), dtype=np.uint8)
    if not len(kinds):
        return []
    return kinds[np.r_[True, kinds[1:] != kinds[:-1]]].tobytes().split()


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: shares of shapes and shape pairs, repeated neighbours, and distinct words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    forms = shapes(raw)
    held: Counter[bytes] = Counter()
    total = max(len(forms), 1)
    for form, n in Counter(forms).items():
        held[b"s" + form] = (n / total) ** 0.5
    for (a, b), n in Counter(zip(forms, forms[1:], strict=False)).items():
        held[b"p" + a + b" " + b] = (n / total) ** 0.5
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if words:
        held[b"r"] = (again / len(words)) ** 0.5
        held[b"d"] = len(set(words)) / len(words)
        held[b"l%d" % len(words).bit_length()] = 1.0
        weight = 0.5 / len(set(words)) ** 0.5
        for word in set(words):
            held[b"w" + word] = weight
    at = np.fromiter((zlib.crc32(k) % buckets for k in held), dtype=np.int32, count=len(held))
    return at, np.fromiter(held.values(), dtype=np.float64, count=len(held))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then logarithms of the gaps."""
    return free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


def loss_and_gradient(scores: np.ndarray, grades: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, its derivative by each score, and by the free threshold numbers."""
    cuts = np.r_[-np.inf, thresholds(free), np.inf]
    upper, lower = sigmoid(cuts[grades + 1] - scores), sigmoid(cuts[grades] - scores)
    upper[np.isinf(cuts[grades + 1])], lower[np.isinf(cuts[grades])] = 1.0, 0.0
    p = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper), lower * (1 - lower)
    by_score = (up - low) / p
    by_cut = np.zeros(len(free))
    inside = grades < len(free)
    np.add.at(by_cut, grades[inside], -(up / p)[inside])
    inside = grades > 0
    np.add.at(by_cut, grades[inside] - 1, (low / p)[inside])
    # A gap moves all later thresholds.
    later = np.cumsum(by_cut[::-1])[::-1]
    by_free = np.r_[later[0], later[1:] * np.exp(free[1:])]
    return float(-np.log(p).sum()), by_score, by_free


def minimise(value, start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving; ``value`` gives loss and gradient and is one job."""
    x = start
    f, g = value(x)
    pairs: deque = deque(maxlen=memory)
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            q -= a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.abs(g).max()))
        for (s, y, rho), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - rho * (y @ q))
        step = 1.0
        while True:
            new_f, new_g = value(x - step * q)
            if new_f <= f - 1e-4 * step * float(g @ q) or step < 1e-3:
                break
            step /= 2
        s, y = -step * q, new_g - g
        if new_f >= f:
            break
        if s @ y > 1e-12:
            pairs.append((s, y, 1 / (s @ y)))
        done = f - new_f < 1e-5 * max(1.0, abs(f))
        x, f, g = x + s, new_f, new_g
        if done:
            break
    return x


class GradeModel:
    """Weights of hashed features and thresholds between grades; ``only`` is the grade that is certain instead."""

    def __init__(self, weights: np.ndarray, free: np.ndarray, only: int | None = None) -> None:
        self.weights, self.free, self.only = weights, free, only

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        at, values = features(text, len(self.weights))
        return 1 - sigmoid(thresholds(self.free) - float(self.weights[at] @ values))

    def predict(self, text: str | None, grade: int) -> tuple[float, float]:
        """Expected grade and P(grade >= ``grade``)."""
        if self.only is not None:
            return float(self.only), float(self.only >= grade)
        tails = self.tails(text)
        return float(tails.sum()), float(1.0 if grade <= 0 else tails[grade - 1] if grade <= len(tails) else 0.0)

    def score(self, text: Column, grade: int = KEEP_GRADE) -> Column:
        """Struct ``expected_grade``, ``tail``."""

        @F.pandas_udf("expected_grade double, tail double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                rows = [self.predict(t if isinstance(t, str) else None, grade) for t in texts]
                yield pd.DataFrame(rows, columns=["expected_grade", "tail"])

        return score.asNondeterministic()(text)


def fit(
    docs: DataFrame, ratings: DataFrame, grade: Column, text_col: str = "text", id_col: str = "doc_id",
    fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, rounds: int = ROUNDS,
) -> GradeModel:
    """Fit on about ``fit_rows`` rated documents; ``grade`` (0, 1, ...) is read from the rows of ``ratings``.

    The chosen ids and grades are at most about ``fit_rows`` small rows and go to every task.
    """
    rated = ratings.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    rated = rated.where(hash_share(rated.count(), fit_rows, "id"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t, buckets) for t in batch["text"]]
            yield pd.DataFrame({"grade": batch["grade"], "at": [r[0] for r in rows], "x": [r[1] for r in rows]})

    sample = texts.join(F.broadcast(rated), "id").select("text", "grade")
    # Each step brings one gradient of every task to the driver: the sample is dealt to a fixed number of them.
    sample = materialize(sample.mapInPandas(hashed, "grade int, at array<int>, x array<double>").repartition(FIT_TASKS), "quality-sample")
    grades = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    if len(grades) < 2:
        return GradeModel(np.zeros(buckets), np.zeros(1), next(iter(grades), 0))
    rows, top = sum(grades.values()), max(grades)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, free = x[:buckets], x[buckets:]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, gradient = 0.0, np.zeros(len(x))
            for batch in batches:
                sizes = batch["at"].map(len).to_numpy(np.int64)
                at, values = np.concatenate(batch["at"].to_numpy()), np.concatenate(batch["x"].to_numpy())
                row = np.repeat(np.arange(len(batch)), sizes)
                scores = np.bincount(row, weights=weights[at] * values, minlength=len(batch))
                more, by_score, by_free = loss_and_gradient(scores, batch["grade"].to_numpy(np.int64), free)
                loss += more
                # A higher score lowers the loss where the density falls off above it.
                gradient[:buckets] += np.bincount(at, weights=by_score[row] * values, minlength=buckets)
                gradient[buckets:] += by_free
            yield pd.DataFrame({"loss": [loss], "gradient": [gradient.tobytes()]})

        parts = sample.mapInPandas(part, "loss double, gradient binary").collect()
        gradient = sum(np.frombuffer(r["gradient"]) for r in parts) / rows
        loss = sum(r["loss"] for r in parts) / rows
        gradient = gradient + RIDGE * np.r_[weights, np.zeros(len(free))]
        return loss + RIDGE / 2 * float(weights @ weights), gradient

    below = np.cumsum([grades.get(k, 0) + 0.5 for k in range(top)]) / (rows + 0.5 * (top + 1))
    cuts = np.log(below / (1 - below))
    start = np.r_[np.zeros(buckets), cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))]
    x = minimise(value, start, rounds)
    return GradeModel(x[:buckets], x[buckets:])


def rating_grade() -> Column:
    """Three grades from two marks: 0 for low quality, 1 for good but toxic, 2 for good."""
    good = F.col("quality") >= 1
    return F.when(~good, 0).when(good & (F.coalesce("toxic", F.lit(0)) >= 1), 1).when(good, 2)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(crc_bucket("doc_id", 5) != 0), rating_grade())
    scored = docs.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), model.score(F.col("text")).alias("_s"))
    return scored.select("doc_id", "held_out", "_s.expected_grade", "_s.tail", (F.col("_s.tail") >= KEEP_TAIL).alias("keep"))

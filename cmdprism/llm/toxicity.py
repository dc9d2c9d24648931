"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (three letters deep, counted over all documents) and a channel model restore words that
were disguised: digits and signs for letters (``1d10t``, ``worthle$$``), letters or signs set apart (``s c u m``,
``m 0 r 0 n``) and stretched letters (``stuuupid``), also together. Each disguised stretch becomes one lattice of swaps,
gaps and repeats, and the Viterbi path with the lowest cost (-log2 of language model and channel) replaces it. Only a
stretch without any letter is no candidate: it is a number. The restored text is scored: every word and every beginning of a
word has a smoothed share of toxic documents, and a small logistic regression over a document's two highest
log-odds and its number of words gives the probability.

The regression is trained on log-odds from which the document's own label is taken out, so words met once don't
look certain.

Defined results: null and empty texts get the score of a text without words. Documents with several labels count as
toxic if any is; rows that repeat an id share its label. Without labels of both kinds every score is the share of
toxic ones (0 if there are none). Empty tables give no rows; extra columns take no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import crc_bucket, hash_share, in_steps
from cmdprism.sources.tables import materialize

#: Word shares are learnt from about this many labelled documents, chosen by a hash of the id.
FIT_ROWS = 100_000
THRESHOLD = 0.3
#: A share is pulled to the overall one as if by so many more documents.
PRIOR_ROWS = 4.0
STARTS = (4, 6)

#: Letters of the language model: 0 parts words, 1 to 26 are a to z without accents, 27 is any other letter.
GAP, OTHER, LETTERS = 0, 27, 28
#: Readings of signs that stand for letters; fixed values.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
#: Channel costs in bits.
SWAPPED, KEPT_SIGN, JOINED, KEPT_GAP, SHORTENED, KEPT_DOUBLE = 1.0, 12.0, 0.5, 6.0, 1.0, 2.0
#: Exclamation marks that end a stretch are mostly what they look like.
KEPT_MARK = 1.0
#: A run of one sign stands for up to so many letters (``v111age``).
RUN_LETTERS = 4

SIGNS = "0-9@$!|+"
GAPS = r" .\-_*"
UNIT = rf"(?:[^\W\d_]|[{SIGNS}])"
#: A sign beside a letter.
LEET = re.compile(rf"[{SIGNS}](?=[^\W\d_])|(?<=[^\W\d_])[{SIGNS}]")
LEET_WORD = re.compile(rf"(?:[^\W_]|[{SIGNS}])+")
#: Three or more letters or signs, each alone or repeated, with runs of separators between them.
SPACED = re.compile(
    rf"(?<![^\W_])(?<![@$|+])(?:(?!!)|(?<!!))({UNIT})\1*+[{GAPS}]++({UNIT})\2*+[{GAPS}]++({UNIT})\3*+(?:[{GAPS}]++({UNIT})\4*+)*(?![^\W_])"
)
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
WORD_END = re.compile(r"(?:[^\W_])*")
RUN = re.compile(rf"[{GAPS}]+|(.)\1*", re.S)
LETTER = re.compile(r"[^\W\d_]")
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """Class of every code point below 0x250; the last entry serves all above."""
    out = np.zeros(0x251, dtype=np.uint8)
    for cp in range(0x250):
        char = chr(cp).lower()
        plain = unicodedata.normalize("NFKD", char)[:1]
        out[cp] = ord(plain) - 96 if "a" <= plain <= "z" else OTHER if char.isalpha() else GAP
    out[0x250] = OTHER
    return out


def class_of(char: str) -> int:
    return int(letter_classes()[min(ord(char), 0x250)])


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of three classes in a row over all texts, each between gaps; runs of gaps are one."""
    joined = "\n\n".join(t for t in texts if t)
    points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = letter_classes()[np.minimum(points, 0x250)].astype(np.int32)
    classes = classes[np.r_[True, (classes[1:] != GAP) | (classes[:-1] != GAP)]]
    classes = np.r_[GAP, classes]
    return np.bincount((classes[:-2] * LETTERS + classes[1:-1]) * LETTERS + classes[2:], minlength=LETTERS**3)


def letter_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """-log2 of the next class after two classes, from all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            for step in in_steps(batch["text"]):
                total += trigram_counts(step)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"at": used, "n": total[used]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "at int, n long")
    rows = counted.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LETTERS**3)
    counts[rows["at"].to_numpy(np.int64)] = rows["n"]
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    pairs = counts.sum(axis=0) + 0.1
    pairs /= pairs.sum(axis=1, keepdims=True)
    return -np.log2((counts + 5 * pairs[None]) / (counts.sum(axis=2, keepdims=True) + 5))


@lru_cache(1)
def point_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs that stand for letters, what the patterns take for letters, separators, and letters or digits.

    The last entry serves all code points from 0x250: they may be letters, and need not be letters or digits.
    """
    sign, letter, gap, alnum = (np.zeros(0x251, dtype=bool) for _ in range(4))
    sign[[ord(c) for c in READINGS]] = True
    gap[[ord(c) for c in " .-_*"]] = True
    letter[:0x250] = [bool(LETTER.match(chr(cp))) for cp in range(0x250)]
    letter[0x250] = True
    alnum[:0x250] = [bool(re.match(r"[^\W_]", chr(cp))) for cp in range(0x250)]
    return sign, letter, gap, alnum


def possible(text: str) -> tuple[bool, bool, bool]:
    """Whether a text may hold letters or signs set apart, signs beside a letter, or a letter three times in a row."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < 2:
        return False, False, False
    low = np.minimum(points, 0x250)
    sign, letter, gap, alnum = (kind[low] for kind in point_kinds())
    leet = bool((sign[:-1] & letter[1:]).any() or (letter[:-1] & sign[1:]).any())
    stretched = bool((letter[2:] & (points[2:] == points[1:-1]) & (points[2:] == points[:-2])).any())
    # Runs of one character, and of separators, count as one.
    first = np.r_[True, (points[1:] != points[:-1]) & ~(gap[1:] & gap[:-1])]
    unit, gap, alnum = (np.r_[False, kind[first], False] for kind in (sign | letter, gap, alnum))
    apart = unit[1:-5] & ~alnum[:-6] & gap[2:-4] & unit[3:-3] & gap[4:-2] & unit[5:-1] & ~alnum[6:] if len(unit) > 6 else unit[:0]
    return bool(apart.any()), leet, stretched


class Restorer:
    """Viterbi decoding of disguised stretches under the letter model."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs
        self.table: list | None = None
        self.known: dict[str, str] = {}

    def readings(self, stretch: str) -> list[list[tuple[str, float]]]:
        """For each run of one character or of separators: what it may stand for, with the channel's cost."""
        gaps = Counter(run.group() for run in RUN.finditer(stretch) if run.group(1) is None)
        usual = max(gaps, key=lambda gap: (gaps[gap], gap != " "), default=None)
        out: list[list[tuple[str, float]]] = []
        for run in RUN.finditer(stretch):
            char, size = run.group(1), len(run.group())
            if char is None:
                # Another separator than the stretch's usual one rather parts words.
                out.append([("", JOINED), (" ", KEPT_GAP)] if run.group() == usual else [("", KEPT_GAP), (" ", JOINED)])
            elif char in READINGS:
                longest = min(size, RUN_LETTERS)
                swaps = [("".join(x), SWAPPED + SHORTENED * (n < size)) for n in range(1, longest + 1) for x in product(READINGS[char], repeat=n)]
                kept = KEPT_MARK if char == "!" and run.end() == len(stretch) else KEPT_SIGN * size
                out.append([*swaps, (char * size, kept)])
            elif size > 2:
                out.append([(char, SHORTENED), (char * 2, KEPT_DOUBLE)])
            elif size == 2 and usual:
                out.append([(char, SHORTENED), (char * 2, 0.0)])
            else:
                out.append([(char * size, 0.0)])
        return out

    def decode(self, stretch: str) -> str:
        known = self.known.get(stretch)
        if known is not None:
            return known
        if self.table is None:
            self.table = self.costs.tolist()
        # State: the last two classes; value: cost and a chain of the pieces so far.
        states: dict[tuple[int, int], tuple[float, tuple]] = {(GAP, GAP): (0.0, ())}
        for options in [*self.readings(stretch), [(" ", 0.0)]]:
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            for piece, channel in options:
                classes = [class_of(c) for c in piece]
                for (a, b), (cost, chain) in states.items():
                    cost += channel
                    for c in classes:
                        if b != GAP or c != GAP:
                            cost += self.table[a][b][c]
                            a, b = b, c
                    held = following.get((a, b))
                    if held is None or cost < held[0]:
                        following[a, b] = (cost, (chain, piece))
            states = following
        _, chain = min(states.values(), key=lambda x: x[0])
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        out = "".join(reversed(pieces[1:]))
        if len(self.known) < 200_000:
            self.known[stretch] = out
        return out

    def disguised(self, text: str) -> list[tuple[int, int]]:
        """Stretches to decode, in order; those that overlap are one. A pattern is only run where the letters' classes allow a match."""
        spaced, leet, stretched = possible(text)
        found: list[tuple[int, int]] = [m.span() for m in SPACED.finditer(text) if LETTER.search(m.group())] if spaced else []
        done = 0
        for m in LEET.finditer(text) if leet else ():
            if m.start() < done:
                continue
            begin = m.start()
            while begin > done and (text[begin - 1].isalnum() or text[begin - 1] in "@$!|+"):
                begin -= 1
            done = LEET_WORD.match(text, begin).end()
            found.append((begin, done))
        done = 0
        for m in STRETCHED.finditer(text) if stretched else ():
            if m.start() < done:
                continue
            begin = m.start()
            while begin > done and text[begin - 1].isalnum():
                begin -= 1
            done = WORD_END.match(text, begin).end()
            found.append((begin, done))
        out: list[tuple[int, int]] = []
        for begin, end in sorted(found):
            if not out or begin >= out[-1][1]:
                out.append((begin, end))
            elif end > out[-1][1]:
                out[-1] = out[-1][0], end
        return out

    def restore(self, text: str | None) -> str:
        """The text in lower case with its disguised stretches decoded."""
        text = (text or "").lower()
        parts, done = [], 0
        for begin, end in self.disguised(text):
            parts += [text[done:begin], self.decode(text[begin:end])]
            done = end
        return "".join([*parts, text[done:]])


def features_of(restored: str) -> set[bytes]:
    """Words, and beginnings of longer words marked by a caret."""
    words = set(restored.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    starts = {b"^" + w[:n] for n in STARTS for w in words if len(w) > n}
    return words | starts


class WordScores:
    """Toxic and clean documents of each feature, and the regression over a document's features."""

    def __init__(self, counts: dict[bytes, tuple[int, int]], toxic: int, clean: int) -> None:
        self.counts, self.toxic, self.clean = counts, toxic, clean
        self.weights = np.zeros(4)

    def log_odds(self, toxic: float, clean: float) -> float:
        share = self.toxic / (self.toxic + self.clean)
        return float(np.log((toxic + PRIOR_ROWS * share) / (clean + PRIOR_ROWS * (1 - share))))

    def prepare(self) -> None:
        base = self.log_odds(0, 0)
        self.table = {k: x for k, (t, c) in self.counts.items() if (x := self.log_odds(t, c)) > base}
        self.base = base

    def summary(self, features: set[bytes], label: int | None) -> tuple[float, float, float]:
        """The two highest log-odds of words and word beginnings and the logarithm of the number of features."""
        if label is None:
            odds = sorted((self.table[f] for f in features & self.table.keys()), reverse=True)[:2]
        else:
            held = [self.counts[f] for f in features & self.counts.keys()]
            odds = sorted((self.log_odds(t - label, c - (1 - label)) for t, c in held), reverse=True)[:2]
        odds = [max(x, self.base) for x in odds] + [self.base] * (2 - len(odds))
        return odds[0], odds[1], float(np.log1p(len(features)))

    def fit(self, rows: pd.DataFrame) -> None:
        """Newton steps for a logistic regression with a small ridge."""
        x = np.column_stack([np.ones(len(rows)), rows[["first", "second", "size"]].to_numpy()])
        y = rows["label"].to_numpy(float)
        w = np.zeros(4)
        ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, restored: str) -> float:
        if not self.toxic or not self.clean:
            return 1.0 if self.toxic else 0.0
        z = self.weights @ np.array([1.0, *self.summary(features_of(restored), None)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class ToxicityModel:
    def __init__(self, restorer: Restorer, words: WordScores) -> None:
        self.restorer, self.words = restorer, words

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic."""
        restorer, words = self.restorer, self.words

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words.prepare() if words.toxic and words.clean else None
            for texts in batches:
                yield pd.Series([words.score(restorer.restore(t if isinstance(t, str) else None)) for t in texts])

        return score.asNondeterministic()(text)


def fit(
    docs: DataFrame, labels: DataFrame, learn_from: Column, text_col: str = "text", id_col: str = "doc_id",
    label_col: str = "toxic", fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """Count letters over all documents; learn word shares from about ``fit_rows`` labelled ones.

    ``learn_from`` is a condition on the labels' rows. The chosen ids and labels are at most about ``fit_rows`` small
    rows and go to every task; word counts that reach the driver are of words of at least two toxic documents.
    """
    restorer = Restorer(letter_model(docs, text_col))
    usable = labels.where(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.where(hash_share(known.count(), fit_rows, "id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": [restorer.restore(t) for t in batch["text"]], "label": batch["label"]})

    train = materialize(texts.select("text", "label").mapInPandas(restore, "text string, label int"), "toxicity-train")
    sizes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sum(n for k, n in sizes.items() if k)
    if not clean or not toxic:
        return ToxicityModel(restorer, WordScores({}, toxic, clean))

    def counts_of(rows: DataFrame, wanted: set[bytes] | None) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: Counter[bytes] = Counter()
            for batch in batches:
                for text in batch["text"]:
                    held.update(features_of(text) if wanted is None else features_of(text) & wanted)
            yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(held.values(), dtype="int64")})

        return rows.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    in_toxic = {bytes(r[0]): r[1] for r in counts_of(train.where("label <> 0"), None).where("n >= 2").toLocalIterator()}
    in_clean = {bytes(r[0]): r[1] for r in counts_of(train.where("label = 0"), set(in_toxic)).toLocalIterator()}
    share = toxic / (toxic + clean)
    counts = {w: (t, in_clean.get(w, 0)) for w, t in in_toxic.items()}
    words = WordScores({w: (t, c) for w, (t, c) in counts.items() if t / (t + c) > share}, toxic, clean)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words.prepare()
        for batch in batches:
            rows = [
                (*words.summary(features_of(t), int(y > 0)), int(y > 0))
                for t, y in zip(batch["text"], batch["label"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["first", "second", "size", "label"])

    words.fit(train.mapInPandas(summarise, "first double, second double, size double, label int").toPandas())
    return ToxicityModel(restorer, words)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, crc_bucket("doc_id", 4) != 2)
    scored = docs.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

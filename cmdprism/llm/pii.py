"""Personal data by weak supervision.

Fixed patterns give the base spans, looser ones give further candidates. Labelers vote on every candidate (1 personal data,
-1 not, 0 no opinion): the strict pattern, a checksum or format test, a gazetteer, words before the span, and its
neighbours. The votes of all candidates are counted, expectation-maximisation estimates from the counts how reliable each
labeler is for each kind, and the posteriors train a logistic span classifier over votes, kind, length and digits. Candidates
that the classifier accepts and that touch no base span are added.

Defined results: null and empty texts have no spans. Spans of one kind don't overlap each other, an added span touches no
other span of any kind; base spans always stay. A corpus without candidates gives a classifier that adds nothing. Repeated
rows count and are scanned alone; extra columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "format", "gazetteer", "context", "neighbours")
#: Characters before a candidate in which the context labeler looks for words.
CONTEXT = 32
ACCEPT = 0.5
FEATURES = "array<int>"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits before a number's first one would begin the match earlier, so only whole digit runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser candidates.
SPELT_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}"
)
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
GROUP = re.compile(r"[0-9]+")

#: Gazetteers: common top-level domains, first digits of card networks, country calling codes, words near each kind; fixed values.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at ca au jp cn in br ru".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65", "22", "23", "24", "25", "26", "27", "35", "36")
CALLING_CODES = ("1", "7", "20", "27", "3", "40", "41", "43", "44", "45", "46", "47", "48", "49", "5", "6", "8", "9")
NEAR = {
    "email": re.compile(r"mail|contact|correo|courriel|kontakt|write to", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|payment|konto", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|anruf|appel|llama", re.I),
}
FAR = {
    "email": re.compile(r"example|noreply", re.I),
    "ip": re.compile(r"version|\bv$|release|section|chapter", re.I),
    "card": re.compile(r"isbn|serial|order|hash|token|id[:=#]", re.I),
    "phone": re.compile(r"isbn|serial|version|order|ratio", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the local part, @ and domain: each belongs to one @, so those are looked up."""
    done = 0
    for m in DOMAIN.finditer(text):
        begin = m.start()
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < m.start():
            yield begin, m.end()
            done = m.end()


def base_and_dropped(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans by kind, then start; and the matches that failed their test."""
    kept, dropped = [], []
    if "@" in text:
        kept += [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = digits_of(m.group())
            if kind == "ip":
                good = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))
            elif kind == "card":
                good = 16 <= len(digits) <= 19 and luhn(digits)
            else:
                good = 8 <= len(digits) <= 15
            if good:
                kept.append((kind, *m.span()))
            elif kind == "ip" or len(digits) >= 8:
                dropped.append((kind, *m.span()))
    return kept, dropped


def further(text: str, dropped: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that the fixed patterns don't give."""
    out = []
    if "(" in text or "[" in text:
        out += [("email", *m.span()) for m in SPELT_EMAIL.finditer(text)]
    out += [("card", *m.span()) for m in DOTTED_CARD.finditer(text)]
    out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    for kind, a, b in dropped:
        if kind == "ip":
            continue
        groups = [(m.start(), m.end()) for m in GROUP.finditer(text, a, b)]
        if kind == "phone":
            # A run of too many digits may begin with a phone number: the longest one, so that none is masked in part.
            sizes = np.cumsum([e - s for s, e in groups])
            fits = np.flatnonzero((sizes >= 8) & (sizes <= 15))
            out += [("phone", a, groups[j][1]) for j in fits[-1:]]
            continue
        # A long run of numbers may hold a card number: consecutive groups of 13 to 19 digits.
        for i in range(len(groups)):
            size = 0
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size >= 13 and luhn(digits_of(text[groups[i][0] : groups[j][1]])):
                    out.append(("card", groups[i][0], groups[j][1]))
    return out


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """What each labeler says about a candidate."""
    value = text[a:b]
    digits = digits_of(value)
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", value.rstrip("])"))[-1].lower()
        form = 1 if last.isalpha() and len(last) >= 2 else -1
        listed = 1 if last in TOP_DOMAINS else 0
    elif kind == "ip":
        parts = value.split(".")
        form = -1 if any(len(p) > 1 and p[0] == "0" or int(p[:9]) > 255 for p in parts) else 1
        small = sum(int(p[:9]) < 10 for p in parts)
        listed = -1 if small == 4 else 1 if parts[0] in ("10", "127", "172", "192") else 0
    elif kind == "card":
        form = 1 if luhn(digits) and 13 <= len(digits) <= 19 else -1
        listed = 1 if digits.startswith(CARD_STARTS) else -1
    else:
        form = 1 if 8 <= len(digits) <= 15 else -1
        listed = 1 if value.startswith("+") and digits.startswith(CALLING_CODES) else 0
    before = text[max(0, a - CONTEXT) : a]
    near, far = bool(NEAR[kind].search(before)), bool(FAR[kind].search(before))
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    return (1 if strict else -1, form, listed, near - far, -1 if glued else 1)


def describe(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """Kind, votes, and classes of length and digit share: all that the models see of a candidate."""
    digits = len(digits_of(text[a:b]))
    return (KINDS.index(kind), *votes(text, kind, a, b, strict), min((b - a) // 4, 9), 4 * digits // (b - a))


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base, dropped = base_and_dropped(text)
    return base, further(text, dropped)


def description_counts(docs: DataFrame, text_col: str) -> dict[tuple[int, ...], int]:
    """How many candidates of all documents look alike to the models; at most some thousand descriptions exist."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                base, more = candidates(text)
                held.update(describe(text, *span, True) for span in base)
                held.update(describe(text, *span, False) for span in more)
        yield pd.DataFrame({"what": pd.Series([list(k) for k in held], dtype=object), "n": pd.Series(held.values(), dtype="int64")})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, f"what {FEATURES}, n long")
    return {tuple(r["what"]): r["n"] for r in counted.groupBy("what").agg(F.sum("n").alias("n")).collect()}


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior that each vote pattern is personal data, by expectation-maximisation with independent labelers."""
    # Start from the sum of votes; every labeler has shares of its three votes for either truth.
    p = 1 / (1 + np.exp(-patterns.sum(axis=1)))
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 1e-3, 1 - 1e-3)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k in range(patterns.shape[1]):
            shares = []
            for weight in (n * p, n * (1 - p)):
                mass = np.array([weight[patterns[:, k] == v].sum() for v in (-1, 0, 1)]) + 1.0
                shares.append(mass / mass.sum())
            odds += np.log(shares[0] / shares[1])[patterns[:, k] + 1]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def design(descriptions: np.ndarray) -> np.ndarray:
    """Classifier inputs: kind, votes, length and digit classes as indicators."""
    columns = [np.ones(len(descriptions))]
    columns += [descriptions[:, 0] == k for k in range(len(KINDS))]
    columns += [descriptions[:, 1 + k] * 1.0 for k in range(len(LABELERS))]
    columns += [descriptions[:, 6] == k for k in range(10)]
    columns += [descriptions[:, 7] == k for k in range(5)]
    return np.column_stack(columns).astype(float)


class SpanClassifier:
    """Logistic regression on the posteriors; its input is the same for candidates that look alike."""

    def __init__(self, counts: dict[tuple[int, ...], int]) -> None:
        self.weights: np.ndarray | None = None
        if not counts:
            return
        rows = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[tuple(int(x) for x in r)] for r in rows], dtype=float)
        posterior = np.zeros(len(rows))
        for kind in np.unique(rows[:, 0]):
            of = rows[:, 0] == kind
            posterior[of] = estimate(rows[of, 1 : 1 + len(LABELERS)], n[of])
        x = design(rows)
        w = np.zeros(x.shape[1])
        share = n / n.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(hessian, x.T @ (share * (p - posterior)) + 1e-4 * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w
        self.known: dict[tuple[int, ...], float] = {}

    def probability(self, what: tuple[int, ...]) -> float:
        if self.weights is None:
            return 0.0
        if what not in self.known:
            z = float(design(np.array([what]))[0] @ self.weights)
            self.known[what] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return self.known[what]

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans: base and accepted ones, each by kind, then start."""
        if not text:
            return [], []
        base, more = candidates(text)
        covered = bytearray(len(text))
        for _, a, b in base:
            covered[a:b] = b"\x01" * (b - a)
        scored = [(-self.probability(describe(text, *span, False)), span) for span in more]
        added: list[tuple[str, int, int]] = []
        for minus_p, (kind, a, b) in sorted(scored):
            if -minus_p >= ACCEPT and covered.find(1, a, b) < 0:
                covered[a:b] = b"\x01" * (b - a)
                added.append((kind, a, b))
        order = {k: i for i, k in enumerate(KINDS)}
        return base, sorted([*base, *added], key=lambda s: (order[s[0]], s[1]))


def fit(docs: DataFrame, text_col: str = "text") -> SpanClassifier:
    return SpanClassifier(description_counts(docs, text_col))


SPANS = "array<struct<kind: string, start: int, end: int>>"


def found(model: SpanClassifier, text: Column) -> Column:
    """Struct ``base``, ``spans``: arrays of (kind, start, end) in code points."""

    def rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = [model.spans(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame({"base": [rows(b) for b, _ in both], "spans": [rows(s) for _, s in both]})

    return scan.asNondeterministic()(text)


def masked(model: SpanClassifier, text: Column) -> Column:
    """The text with every span replaced by its kind in square brackets; of overlapping spans one mark is left."""

    def mask(text: str | None) -> str | None:
        if not isinstance(text, str):
            return None
        merged: list[list] = []
        for kind, a, b in sorted(model.spans(text)[1], key=lambda s: (s[1], s[2])):
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([kind, a, b])
        cuts = [0, *[x for _, a, b in merged for x in (a, b)], len(text)]
        outside = [text[a:b] for a, b in pairwise(cuts)][::2]
        marks = [f"[{kind.upper()}]" for kind, _, _ in merged]
        return "".join(x for pair in zip(outside, [*marks, ""], strict=True) for x in pair)

    @F.pandas_udf("string")
    def mask_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask(t) for t in texts], dtype=object)

    return mask_all.asNondeterministic()(text)


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    spans = docs.select("doc_id", found(model, F.col("text")).alias("_f"))
    base = F.col("_f.base")
    return spans.select(
        "doc_id",
        *[count_of(base, kind) for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("_f.spans")).alias("spans"),
    )

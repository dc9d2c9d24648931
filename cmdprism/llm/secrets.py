"""Secret scan with DataFrame functions only: fixed patterns, and sliding-window entropy of token runs.

Positions come from marking: a pattern's matches are put between two private-use characters, the text is
split there, and the lengths of the parts add up to code-point offsets. Private-use marks that a text holds
itself are first replaced by another private-use character, one for one, which no pattern accepts.

Entropy: candidates are runs of 20 and more characters of the base64 and URL alphabets with a letter and a digit.
A fold moves a window of 20 characters along the run. Its state holds the count of every character of the run and the sum of
n*log2(n) over these counts n; a step changes the two counts of the character that leaves and the one that enters, and the sum by
their terms. Entropy is log2(20) - sum/20. The highest
window must reach the threshold of the run's character class, and no allow-list pattern may match the run.

Defined results: null and empty texts have no spans. Spans of one kind don't overlap; base spans always stay,
and an ``entropy`` span that touches one is left out. Repeated rows are scanned alone; extra columns of any name
are kept, but one named like ``out_col`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import Aside

WINDOW = 20
#: Base patterns, group 1 what stands before the value and group 2 the value, and the value's least length; fixed
#: values. Runs of one character class are asked for at their least length at once: a shorter run holds none.
#: ``assign`` is not, since a match whose value is too short still uses up its characters.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"()(AKIA[A-Z0-9]{16,})", 20),
    "hex": (r"()([0-9a-f]{24,})", 24),
}
RUN = r"()([A-Za-z0-9+/_=-]{20,})"
#: Highest window entropy in bits that a run of each character class must reach; the first class that fits counts.
CLASSES = [
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("upper", r"^[A-Z0-9]+$", 3.5),
    ("lower", r"^[a-z0-9]+$", 3.5),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
]
#: Runs that look random and are no secrets.
ALLOWED = [
    r"^[0-9+/_=-]+$",  # numbers and dates
    r"^[A-Za-z+/_=-]+$",  # words and paths without digits
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z]+([/_-][A-Za-z]+)*[/_-]?[0-9]{1,4}$",  # path or slug with a number at its end
    r"(?i)(example|sample|dummy|placeholder|xxxx|0000)",
]
OPEN, PART, CLOSE, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
ENTROPY = "entropy"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's leftmost non-overlapping matches."""
    marked = F.regexp_replace(
        F.translate(text, OPEN + PART + CLOSE, OTHER * 3), pattern, f"{OPEN}$1{PART}$2{CLOSE}"
    )
    parts = F.split(marked, f"[{OPEN}{CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        inside = F.instr(part, PART) > 0
        size = F.length(part) - inside.cast("int")
        span = F.struct(
            state["at"].alias("start"), (state["at"] + size).alias("end"), F.substring_index(part, PART, -1).alias("value")
        )
        return F.struct(
            (state["at"] + size).alias("at"), F.when(inside, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out")
        )

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(none)


def weight(n: Column) -> Column:
    """n * log2(n), 0 for 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest entropy in bits of any window of ``value`` (at least as long as a window)."""

    def slide(codes: Column, state: Column, i: Column) -> Column:
        """The window that began at i - 1 moves to i (1-based)."""

        def moved(ends: Column) -> Column:
            gone, come = ends["gone"], ends["come"]
            n_gone = F.element_at(state["counts"], gone)
            n_come = F.element_at(state["counts"], come)
            total = state["sum"] - weight(n_gone) + weight(n_gone - 1) + weight(n_come + 1) - weight(n_come)
            counts = F.transform(state["counts"], lambda n, k: n - (k == gone - 1).cast("int") + (k == come - 1).cast("int"))
            after = F.when(gone == come, state["sum"]).otherwise(total)
            return let(
                after,
                lambda sum_: F.struct(
                    F.when(gone == come, state["counts"]).otherwise(counts).alias("counts"), sum_.alias("sum"),
                    F.least(state["least"], sum_).alias("least"),
                ),
            )

        return let(F.struct(F.element_at(codes, i - 1).alias("gone"), F.element_at(codes, i + F.lit(window - 1)).alias("come")), moved)

    def least_sum(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(1), F.array_max(codes)), lambda k: F.size(F.filter(first, lambda c: c == k)))
        later = F.when(F.size(codes) > window, F.sequence(F.lit(2), F.size(codes) - (window - 1))).otherwise(F.array().cast("array<int>"))

        def folded(begun: Column) -> Column:
            return let(
                F.aggregate(begun, F.lit(0.0), lambda s, n: s + weight(n)),
                lambda total: F.aggregate(
                    later,
                    F.struct(begun.alias("counts"), total.alias("sum"), total.alias("least")),
                    lambda state, i: slide(codes, state, i),
                    lambda state: state["least"],
                ),
            )

        return let(counts, folded)

    def coded(chars: Column) -> Column:
        """Each character as its place among the run's different ones."""
        return let(F.array_distinct(chars), lambda known: F.transform(chars, lambda c: F.array_position(known, c).cast("int")))

    return F.log2(F.lit(float(window))) - let(let(F.split(value, ""), coded), least_sum) / window


def random_looking(value: Column) -> Column:
    """True where the run's class threshold is reached and no allow-list pattern matches."""
    threshold = F.coalesce(*[F.when(value.rlike(p), F.lit(bits)) for _, p, bits in CLASSES])
    suspect = F.lit(True)
    for pattern in ALLOWED:
        suspect = suspect & ~value.rlike(pattern)
    return F.when(suspect, highest_entropy(value) >= threshold).otherwise(False)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read and don't compute again: they can't be merged across it."""
    return df.withColumn(name, F.explode(F.array(value)))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "_spans") -> DataFrame:
    """``docs`` with an array ``out_col`` of (start, rank, end, kind), by start, then kind."""
    aside = Aside(docs)
    text = F.coalesce(F.col(aside[text_col]), F.lit(""))
    patterns = {kind: pattern for kind, (pattern, _) in BASE.items()} | {ENTROPY: RUN}
    found = once(aside.rows, "found", F.struct(*[matches(text, p).alias(kind) for kind, p in patterns.items()]))

    def spans(kind: str, rank: int, kept: Column) -> Column:
        return F.transform(
            kept,
            lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    def long_enough(kind: str, least: int) -> Column:
        return F.filter(F.col("found")[kind], lambda m: F.length(m["value"]) >= least)

    base = [spans(kind, rank, long_enough(kind, least)) for rank, (kind, (_, least)) in enumerate(BASE.items())]
    found = once(found, "base", F.concat(*base))
    added = F.filter(
        F.col("found")[ENTROPY],
        lambda m: F.when(
            F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])), False
        ).otherwise(random_looking(m["value"])),
    )
    found = once(found, "spans", F.array_sort(F.concat("base", spans(ENTROPY, len(BASE), added))))
    return found.select(*aside.back(out_col), F.col("spans").alias(out_col))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6(docs: DataFrame) -> DataFrame:
    spans = F.col("_spans")
    base = F.filter(spans, lambda s: s["kind"] != ENTROPY)
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count_of(spans, kind) for kind in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        count_of(spans, ENTROPY),
    )

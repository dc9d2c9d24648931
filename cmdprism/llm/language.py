"""Language identification by prediction by partial matching.

Per language, a variable-order byte context tree (orders 3 to 0) holds frozen counts. A byte costs
-log2 of its share in the longest context that has seen it, plus the escape costs of the longer
contexts that haven't (escape method C: distinct followers / (followers + distinct)); a byte no
context knows costs the escapes plus 8 bits. The language with the shortest code of the whole text wins,
and the score is its share of the posterior 2^-bits under equal priors.

A code length depends on four bytes only, so the trees are kept as sorted four-byte strings and the
code lengths of all strings seen in training are computed once per worker; others are computed when met.

Defined results: null, empty and letterless texts are ``und`` with score 0. Ties go to the first language
by name. Without any training text every text with a letter is ``und``, too. Repeated rows are scored alone;
extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import crc_bucket, in_steps

#: The trees are fitted on about this many documents of each language, chosen by a hash of the id.
FIT_ROWS_PER_LANGUAGE = 4000
ORDER = 3
UNDEFINED = "und"

#: ASCII letters stay, bytes from 0x80 stay, everything else is a space.
LETTER_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def letter_bytes(text: str) -> bytes:
    """Lower-case text as bytes in which every run of other characters is one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTER_BYTES).split())


def windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All four-byte strings of the bodies, each body after three spaces; begin and end of each body's strings."""
    joined = np.frombuffer(b"".join(b"   " + x for x in bodies) + b"   ", dtype=np.uint8)
    sizes = np.array([len(x) for x in bodies], dtype=np.int64)
    begin = np.cumsum(sizes + 3) - sizes - 3
    wide = joined.astype(np.uint32)
    codes = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    return codes, begin, begin + sizes


def count_strings(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes, begin, end = windows(bodies)
    inside = np.zeros(len(codes) + 1, dtype=np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    return np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)


class ContextTree:
    """Frozen counts of one language: for each order the strings (context, byte) and the contexts."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray) -> None:
        self.nodes = []
        for order in range(ORDER, -1, -1):
            strings, at = np.unique(strings & (256 ** (order + 1) - 1), return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(strings))
            contexts, of = np.unique(strings >> 8, return_inverse=True)
            followers = np.bincount(of, weights=counts, minlength=len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            share = -np.log2(counts / (followers + kinds)[of])
            self.nodes.append((order, strings, share, contexts, -np.log2(kinds / (followers + kinds))))

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string after the three before it."""
        bits, open_rows = np.zeros(len(codes)), np.arange(len(codes))
        for order, strings, share, contexts, escape in self.nodes:
            part = codes[open_rows] & (256 ** (order + 1) - 1)
            at = np.minimum(np.searchsorted(strings, part), len(strings) - 1)
            seen = strings[at] == part
            bits[open_rows[seen]] += share[at[seen]]
            open_rows, part = open_rows[~seen], part[~seen] >> 8
            at = np.minimum(np.searchsorted(contexts, part), len(contexts) - 1)
            known = contexts[at] == part
            bits[open_rows[known]] += escape[at[known]]
        bits[open_rows] += 8
        return bits


class LanguageModel:
    """Context trees of all languages and the code lengths of every string seen in training."""

    SLOT_BITS = 21

    def __init__(self, strings: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.names = sorted(strings)
        self.strings = strings
        self.ready = False

    def prepare(self) -> None:
        """Once per worker; the trees are rebuilt from the counts there."""
        if self.ready:
            return
        self.trees = [ContextTree(s.astype(np.uint64), n.astype(float)) for s, n in map(self.strings.get, self.names)]
        self.known = np.unique(np.concatenate([s for s, _ in self.strings.values()]).astype(np.uint32))
        self.cost = self._exact(self.known)
        # A table by hash finds nearly all strings in one step; what lost its slot is looked up in the sorted list.
        self.slots = np.full(1 << self.SLOT_BITS, -1, dtype=np.int32)
        self.slots[self._slot(self.known)] = np.arange(len(self.known))
        self.ready = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - self.SLOT_BITS)

    def _exact(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.code_lengths(codes.astype(np.uint64)) for t in self.trees], axis=1)

    def bits(self, bodies: list[bytes]) -> np.ndarray:
        """Code length of every body under every language."""
        codes, begin, end = windows(bodies)
        row = self.slots[self._slot(codes)]
        missed = np.flatnonzero(self.known[row] != codes)
        others, at = np.unique(codes[missed], return_inverse=True)
        extra = self._exact(others)
        out = np.empty((len(bodies), len(self.names)))
        for k in range(len(self.names)):
            cost = self.cost[row, k]
            cost[missed] = extra[at, k]
            total = np.concatenate([[0.0], np.cumsum(cost)])
            out[:, k] = total[end] - total[begin]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out = [(UNDEFINED, 0.0)] * len(texts)
        if not rows or not self.names:
            return out
        self.prepare()
        bits = self.bits([letter_bytes(texts[i]) for i in rows])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        for i, k, p in zip(rows, best, share, strict=True):
            out[i] = (self.names[k], float(p))
        return out


def fit(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, rows_each: int = FIT_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Count the four-byte strings of about ``rows_each`` whole texts of every language.

    What reaches the driver is bounded by the documents fitted on, not by the table.
    """
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return LanguageModel({})
    parts = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_each / n))])
    draw = F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1_000_003)) / 1_000_003
    chosen = labelled.where(draw < parts[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for step in in_steps(texts):
                    strings, counts = count_strings([letter_bytes(t) for t in step])
                    yield pd.DataFrame({"lang": lang, "string": strings.astype(np.int64), "n": counts})

    counted = chosen.mapInPandas(count, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    return LanguageModel(
        {k: (g["string"].to_numpy(np.uint32), g["n"].to_numpy(np.int64)) for k, g in rows.groupby("lang") if len(g)}
    )


def predicted(model: LanguageModel, text: Column) -> Column:
    """Struct ``lang_pred``, ``score`` of every text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [x for step in in_steps(t if isinstance(t, str) else None for t in texts) for x in model.predict(step)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict.asNondeterministic()(text)


def op1(docs: DataFrame) -> DataFrame:
    held_out = crc_bucket("doc_id", 5) == 0
    model = fit(docs.where(~held_out), "text", "lang", "doc_id")
    scored = docs.select("doc_id", held_out.alias("held_out"), predicted(model, F.col("text")).alias("_p"))
    return scored.select("doc_id", "held_out", "_p.lang_pred", "_p.score")

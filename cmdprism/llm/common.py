"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task holds as arrays at a time.
STEP_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Aside:
    """A table whose columns carry numbered names while helper columns are added, and get their own names back at the end."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """The numbered name of a column; names match as Spark matches them, whatever their case."""
        return f"c{[n.lower() for n in self.names].index(name.lower())}"

    def back(self, *left_out: str) -> list[Column]:
        """All columns but ``left_out``, under their own names."""
        gone = {n.lower() for n in left_out}
        return [F.col(f"c{i}").alias(name) for i, name in enumerate(self.names) if name.lower() not in gone]


def crc_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets))


def hash_share(rows: int, bound: int, *cols: str, seed: int = 7) -> Column:
    """True for about ``bound`` of ``rows`` rows, chosen by a hash of ``cols``; all rows if they are no more."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_003)) < int(1_000_003 * bound / rows)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def in_steps(texts: Iterable[str | None], step_chars: int = STEP_CHARS) -> Iterator[list[str | None]]:
    """Consecutive texts in lists of about ``step_chars`` characters; a longer text makes a list alone."""
    step: list[str | None] = []
    size = 0
    for text in texts:
        step.append(text)
        size += len(text) if text else 0
        if size >= step_chars:
            yield step
            step, size = [], 0
    if step:
        yield step

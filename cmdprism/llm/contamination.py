"""Benchmark decontamination with an FM-index per shard of documents.

Every task turns the words of its documents into benchmark-word numbers, builds an FM-index of them
(suffix array, wavelet matrix of the Burrows-Wheeler transform, sampled suffix positions), runs all
benchmark windows through backward search at once, locates the occurrences and merges them into word
spans. A word that no benchmark item holds ends a run: no occurrence reaches across it, and a run shorter
than the shortest window can hold none, so neither is indexed.

Defined results: a null or empty text has no words, no spans and no items. Items without words are skipped.
An item with a null id still marks documents, but isn't listed. Repeated item ids are listed once, repeated
documents are judged alone. An empty benchmark or an empty document table gives no hits or no rows.
Extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import Aside
from cmdprism.sources.tables import materialize

WINDOW = 10
#: Words that one index covers; longer streams are cut with an overlap of a window.
SHARD_WORDS = 2_000_000
#: Bytes of benchmark text that go to the tasks at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16_000_000
SAMPLE_EVERY = 8
RESULT = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"

#: ASCII letters in lower case and digits stay, other ASCII characters part words, bytes from 0x80 belong to words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Phrases:
    """Benchmark windows as rows of word numbers (from 1), each with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item_id, text in items:
            words = words_of(text)
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(numbers))
            for i in range(len(numbers) - size + 1 if size else 0):
                holders = found.setdefault(tuple(numbers[i : i + size]), [])
                if item_id is not None and item_id not in holders[-1:]:
                    holders.append(item_id)
        self.holders = [sorted(set(x)) for x in found.values()]
        self.lengths = np.array([len(k) for k in found], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.shortest = int(self.lengths.min(initial=window))
        self.words = np.zeros((len(found), self.longest), dtype=np.int64)
        for row, key in zip(self.words, found, strict=True):
            row[: len(key)] = key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    lead = symbols[order]
    new = np.r_[True, lead[1:] != lead[:-1]] if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    ahead = 1
    while True:
        first = rank[order]
        same = first[1:] == first[:-1]
        rows = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if n > 1 else np.zeros(0, dtype=np.int64)
        if not len(rows):
            return order
        at = order[rows]
        after = at + ahead
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = first[rows] * (n + 2) + second
        by_key = np.argsort(key, kind="stable")
        at, key = at[by_key], key[by_key]
        order[rows] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        ahead *= 2


class FMIndex:
    """Backward search and location over one stream of word numbers, in which 0 parts runs."""

    def __init__(self, stream: np.ndarray, alphabet: int) -> None:
        n = len(stream)
        breaks = stream == 0
        parted = int(breaks.sum())
        # Every break sorts as a symbol of its own, so no repeat is longer than a run.
        symbols = np.where(breaks, np.cumsum(breaks) - 1, stream + parted)
        order = suffix_array(symbols)
        self.starts = np.r_[0, np.cumsum(np.bincount(stream, minlength=alphabet + 1))]
        self.last = stream[order - 1]  # what stands before each suffix, in suffix order
        if n:
            self.last[order == 0] = 0
        sampled = (np.arange(n) % SAMPLE_EVERY == 0) | np.r_[True, breaks[:-1]][:n]
        self.position = np.where(sampled[order], order, -1)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = self.last
        for shift in range(max(1, int(alphabet).bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = n - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.n = n

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``upto`` entries of the transform."""
        begin, end = np.zeros(len(upto), dtype=np.int64), upto.astype(np.int64)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1) == 1
            ones_begin, ones_end = ones[begin], ones[end]
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
            end = np.where(one, zeros + ones_end, end - ones_end)
        return end - begin

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur, with their ranges of suffixes."""
        live = np.arange(len(phrases.lengths))
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.n, dtype=np.int64)
        for back in range(phrases.longest):
            going = np.flatnonzero(phrases.lengths[live] > back)
            if not len(going):
                break
            at = live[going]
            symbol = phrases.words[at, phrases.lengths[at] - 1 - back]
            low[going] = self.starts[symbol] + self.rank(symbol, low[going])
            high[going] = self.starts[symbol] + self.rank(symbol, high[going])
            kept = low < high
            live, low, high = live[kept], low[kept], high[kept]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Stream positions of suffixes: step back until a sampled one."""
        found, steps, at = np.full(len(rows), -1, dtype=np.int64), 0, rows.copy()
        open_rows = np.arange(len(rows))
        while len(open_rows):
            known = self.position[at]
            done = known >= 0
            found[open_rows[done]] = known[done] + steps
            open_rows, at = open_rows[~done], at[~done]
            symbol = self.last[at]
            at = self.starts[symbol] + self.rank(symbol, at)
            steps += 1
        return found


def occurrences(stream: np.ndarray, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(stream position, phrase number) of every occurrence."""
    places, numbers = [], []
    for begin in range(0, len(stream), shard_words):
        part = stream[begin : begin + shard_words + phrases.longest - 1]
        # Runs of benchmark words that can hold a window, each followed by one break.
        word = part > 0
        edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
        run_from, run_to = edge[::2], edge[1::2]
        long = run_to - run_from >= phrases.shortest
        run_from, run_to = run_from[long], run_to[long]
        if not len(run_from):
            continue
        sizes = run_to - run_from + 1
        origin = np.arange(sizes.sum()) + np.repeat(run_from - (np.cumsum(sizes) - sizes), sizes)
        compact = np.append(part, 0)[origin]
        compact[np.cumsum(sizes) - 1] = 0
        index = FMIndex(compact, len(phrases.vocabulary))
        hit, low, high = index.search(phrases)
        if not len(hit):
            continue
        counts = high - low
        rows = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        places.append(origin[index.locate(rows)] + begin)
        numbers.append(np.repeat(hit, counts))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(numbers)


def hits_of(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: its number of words, merged word spans, and the sorted items found."""
    get = phrases.vocabulary.get
    parts, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int64))
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in sizes]
    if not parts or not len(phrases.lengths):
        return out
    stream = np.concatenate(parts)
    place, number = occurrences(stream, phrases)
    if not len(place):
        return out
    starts = np.r_[0, np.cumsum(np.array(sizes) + 1)]
    change = np.zeros(len(stream) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + phrases.lengths[number], -1)
    covered = np.cumsum(change) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered].astype(np.int8)))
    span_from, span_to = edge[::2], edge[1::2]
    for doc, a, b in zip(np.searchsorted(starts, span_from, "right") - 1, span_from, span_to, strict=True):
        out[doc][1].append((int(a - starts[doc]), int(b - starts[doc])))
    doc = np.searchsorted(starts, place, "right") - 1
    for key in np.unique(doc * len(phrases.lengths) + number):
        out[key // len(phrases.lengths)][2].extend(phrases.holders[key % len(phrases.lengths)])
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_column(phrases: Phrases, text: Column) -> Column:
    """Hits of one block of phrases."""

    def steps(texts: pd.Series) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        batch: list[str | None] = []
        size = 0
        for value in texts:
            batch.append(value if isinstance(value, str) else None)
            size += len(value) if isinstance(value, str) else 0
            if size >= 6 * SHARD_WORDS:
                yield from hits_of(batch, phrases)
                batch, size = [], 0
        yield from hits_of(batch, phrases)

    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(n, [{"start": a, "end": b} for a, b in s], i) for n, s, i in steps(texts)]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search.asNondeterministic()(text)


def merged_spans(spans: Column) -> Column:
    """Spans as few: overlapping and touching ones are one."""

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["end"] >= x["start"])
        return F.when(touches, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out_col: str = "_hits",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, spans (word positions, end exclusive), items.

    The benchmark is the stated query set: it goes to the tasks in blocks of about ``block_bytes``, chosen by hash. One block is
    searched in a pass without a shuffle. Of several, each one's hits are written before the next is built, so
    neither driver nor tasks hold more than one; only rows with hits meet again.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes

    def phrases_of(block: int) -> Phrases:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        return Phrases([(r["item_id"], r["text"]) for r in rows], window)

    if blocks == 1:
        return docs.withColumn(out_col, search_column(phrases_of(0), F.col(text_col)))
    aside = Aside(docs)
    rows = materialize(aside.rows.withColumn("row", F.monotonically_increasing_id()), "contamination-rows")
    parts = []
    for block in range(blocks):
        hits = rows.select("row", search_column(phrases_of(block), F.col(aside[text_col])).alias("hits"))
        # The first block counts the words of every row.
        parts.append(materialize(hits if block == 0 else hits.where("size(hits.spans) > 0"), "contamination-hits"))
    found = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.max("hits.n_words").alias("n_words"), F.flatten(F.collect_list("hits.spans")).alias("spans"), F.flatten(F.collect_list("hits.items")).alias("items")
    )
    whole = F.struct("n_words", merged_spans(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    joined = rows.join(found.select(F.col("row").alias("of"), whole.alias("found")), F.col("row") == F.col("of"))
    return joined.select(*aside.back(out_col), F.col("found").alias(out_col))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts and digest of what :func:`find_contamination` gives."""

    hits = F.col("_hits")
    n_hit = F.aggregate(hits["spans"], F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_words(text: str) -> str:
    return _SQL_WORDS.format(_SQL_LOWER.format(text))


#: The contract's columns in plain SQL: every run of a window's length in every document.
OP7_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_sql_words('text')} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
grams AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT r, i, g.k AS k, item_id FROM grams g JOIN windows v ON g.gram = v.gram AND g.k = v.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

"""Exact top-k inner products over integer vectors, longest vectors first.

The vectors' Gram matrix gives a rotation (its singular vectors) that gathers most of a product in the
leading axes. Candidates go by falling length. The longest ones are multiplied out with every query and give
each query a first k-th best score; a later block stops a query once length times length falls below that
score, and else bounds each product by the rotated partial sum plus the product of the two residual lengths
(Cauchy-Schwarz). What the bound can't exclude is multiplied out in whole numbers, so the answer is exact.

Defined results: a vector that is null, empty or holds a null, non-finite or immense (``scale * x`` of 1e150) component takes no part, neither as
a query nor as a candidate. Vectors of different length can't be multiplied: a query meets candidates of its own
length only. Equal scores go by the smaller id; a query with fewer than k candidates gets them all. Repeated ids
are rows of their own: each query row has its own list, equal ones too, and every other row is its candidate, also one with
its id. Products are sums of integers in doubles, exact below 2**53; where two lengths could reach it, the product is multiplied out in
Python's integers. A score that does not fit a long is cut to the nearest one, but ranked as it is (up to 38 digits).
Null ids are no queries and no candidates. Empty tables give no rows; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.sources.tables import materialize

SCALE = 256
K = 5
QUERY_STEP = 50
#: Bytes of queries that go to the tasks at once; more are answered in several passes over the candidates.
QUERY_BYTES = 64 << 20
#: The longest vectors that give the first bounds.
SEED_ROWS = 4_096
#: Candidates and queries that are multiplied at a time.
TILE_ROWS, TILE_QUERIES = 2_048, 512
FOUND = "query_id long, query_row long, copies long, vec_id long, score decimal(38, 0)"
#: From this product of lengths on, doubles may round a product.
INEXACT = 2.0**53
MOST = 10**38 - 1
#: Components must stay below, so that squares are finite.
LARGEST = 1e150


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``row`` (a number of the row), ``v`` (integer components as doubles) and squared length ``sq`` of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST))
    # Doubles from 2**53 on are whole already, and may not fit a long.
    whole = F.transform(v, lambda x: F.when(F.abs(x) * scale < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .where((F.size(vector_col) > 0) & finite)
        .select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), whole.alias("v"))
        .withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    )


def gram_matrix(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products: one small matrix from each task."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width * width), "value": total.ravel()})

    parts = vectors.select("v").mapInPandas(outer, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    cells = parts.toPandas()
    out = np.zeros(width * width)
    out[cells["at"]] = cells["value"]
    return out.reshape(width, width)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def products(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of pairs of rows, in Python's integers where doubles could round them."""
    if exact:
        return np.einsum("ij,ij->i", left, right)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True)], object)


class Searcher:
    """Queries, their rotated forms and the scores they must reach."""

    def __init__(self, queries: pd.DataFrame, rotation: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.copies = (queries[c].to_numpy(np.int64) for c in ("id", "row", "copies"))
        self.vectors, self.rotation, self.k = np.stack(queries["v"].to_numpy()), rotation, k
        self.floor = np.full(len(self.ids), -np.inf)
        self.length = np.sqrt((self.vectors**2).sum(axis=1))
        self.head = max(1, self.vectors.shape[1] // 4)
        rotated = self.vectors @ rotation
        self.lead = rotated[:, : self.head]
        self.rest = np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))

    def search(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best k of one task's candidates for each query that any of them can serve; floors rise from batch to batch."""
        floor = self.floor.copy()
        none = (np.zeros(0, np.int64), np.zeros(0))
        held: list[tuple[np.ndarray, np.ndarray]] = [none] * len(floor)
        for batch in batches:
            if len(batch):
                self.search_batch(batch, floor, held)
        served = [q for q, (found, _) in enumerate(held) if len(found)]
        for begin in range(0, len(served), TILE_QUERIES):
            part = served[begin : begin + TILE_QUERIES]
            at = np.repeat(part, [len(held[q][0]) for q in part])
            score = [Decimal(min(max(int(s), -MOST), MOST)) for q in part for s in held[q][1]]
            vec_id = np.concatenate([held[q][0] for q in part])
            yield pd.DataFrame({"query_id": self.ids[at], "query_row": self.rows[at], "copies": self.copies[at], "vec_id": vec_id, "score": score})

    def search_batch(self, batch: pd.DataFrame, floors: np.ndarray, held: list) -> None:
        vectors = np.stack(batch["v"].to_numpy())
        order = np.argsort(-(vectors**2).sum(axis=1), kind="stable")
        ids, own, vectors = batch["id"].to_numpy(np.int64)[order], batch["row"].to_numpy(np.int64)[order], vectors[order]
        length = np.sqrt((vectors**2).sum(axis=1))
        rotated = vectors @ self.rotation
        lead, rest = rotated[:, : self.head], np.sqrt((rotated[:, self.head :] ** 2).sum(axis=1))
        for begin in range(0, len(self.ids), TILE_QUERIES):
            of = slice(begin, begin + TILE_QUERIES)
            floor = floors[of]
            for at in range(0, len(ids), TILE_ROWS):
                tile = slice(at, at + TILE_ROWS)
                slack = 1e-6 * (1 + self.length[of] * length[at])
                live = np.flatnonzero(self.length[of] * length[at] + slack >= floor)
                if not len(live):
                    break  # all later candidates are shorter
                bound = self.lead[of][live] @ lead[tile].T + np.outer(self.rest[of][live], rest[tile])
                rows, cols = np.nonzero(bound + slack[live][:, None] >= floor[live][:, None])
                keep = own[tile][cols] != self.rows[of][live][rows]
                rows, cols = rows[keep], cols[keep]
                if not len(rows):
                    continue
                exact = self.length[of][live].max() * length[at] < INEXACT
                if exact and len(rows) * 4 > bound.size:
                    scores = (self.vectors[of][live] @ vectors[tile].T)[rows, cols]
                else:
                    scores = products(self.vectors[of][live[rows]], vectors[tile][cols], exact)
                cuts = np.searchsorted(rows, np.arange(len(live) + 1))
                for j, q in enumerate(live):
                    a, b = cuts[j], cuts[j + 1]
                    if a == b:
                        continue
                    before, old = held[begin + q]
                    all_ids = np.concatenate([before, ids[tile][cols[a:b]]])
                    all_scores = np.concatenate([old if exact else old.astype(object), scores[a:b]])
                    if old.dtype == object:
                        all_scores = np.array([int(s) for s in all_scores], object)
                    top = best(all_ids, all_scores, self.k)
                    held[begin + q] = (all_ids[top], all_scores[top])
                    if len(top) == self.k:
                        floor[q] = max(floor[q], float(all_scores[top[-1]]))


def search_rows(vectors: DataFrame, searcher: Searcher) -> DataFrame:
    return vectors.select("id", "row", "v").mapInPandas(searcher.search, FOUND)


def top_of(found: DataFrame, k: int) -> DataFrame:
    """At most k rows of each task and query come in, so no query has many rows to rank."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    per_query = found.groupBy("query_id", "query_row", "copies").agg(F.slice(ranked, 1, k).alias("top"))
    per_query = per_query.select("query_id", "top", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    score = F.least(F.greatest(-F.col("x.s"), F.lit(-(2**63)).cast("decimal(38, 0)")), F.lit(2**63 - 1).cast("decimal(38, 0)"))
    return per_query.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), score.cast("long").alias("score")
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    query_bytes: int = QUERY_BYTES,
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row that ``is_query`` (over column ``id``) names.

    A query in ``is_query`` is a stated set against all rows: it goes out in blocks of about ``query_bytes``.
    """
    rows = materialize(integer_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    out = None
    for width in sorted(r[0] for r in rows.select(F.size("v").alias("w")).distinct().collect()):
        own = rows.where(F.size("v") == width)
        _, _, rotation = np.linalg.svd(gram_matrix(own, width))
        rotation = rotation.T
        longest = own.orderBy(F.desc("sq"), "id", "row").limit(min(seed_rows, max(k + 1, query_bytes // (8 * width)))).toPandas()
        # Candidates by falling length: each task's share is a range of lengths.
        ordered = own.repartitionByRange(F.desc("sq"), F.xxhash64("row"))
        # Equal query rows are searched once and answered once each: each skips one of them, itself.
        queries = own.where(is_query).groupBy("id", "v").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
        # A query is held with its rotated form.
        blocks = -(-queries.count() * 16 * width // query_bytes)
        for block in range(blocks):
            mine = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).toPandas()
            if not len(mine):
                continue
            searcher = Searcher(mine, rotation, k)
            searcher.floor = first_floors(searcher, longest)
            found = top_of(search_rows(ordered, searcher), k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def first_floors(searcher: Searcher, longest: pd.DataFrame) -> np.ndarray:
    """The k-th best score of each query among the longest vectors; no bound where they are fewer than k.

    Doubles may round large products, so the floors are lowered by as much.
    """
    rows, vectors = longest["row"].to_numpy(np.int64), np.stack(longest["v"].to_numpy())
    floors = np.full(len(searcher.ids), -np.inf)
    for begin in range(0, len(searcher.ids), TILE_QUERIES):
        of = slice(begin, begin + TILE_QUERIES)
        scores = searcher.vectors[of] @ vectors.T
        scores[searcher.rows[of][:, None] == rows[None, :]] = -np.inf
        if scores.shape[1] >= searcher.k:
            best_of = -np.partition(-scores, searcher.k - 1, axis=1)[:, searcher.k - 1]
            slack = 1e-9 * searcher.length[of] * np.sqrt(longest["sq"].iloc[0])
            floors[of] = np.where(slack > 0.5, best_of - slack, best_of)
    return floors


#: The registered query in plain SQL: every product of a query row and another row.
OP10_SQL = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x) AS score,
    row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % {QUERY_STEP} = 0) WHERE rank <= {K}"""

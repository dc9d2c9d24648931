"""Boosted trees and forests on Spark: many models in one pass, leaf-wise or by level, categories as such, no limit on depth.

Rows are binned once into a written table. Trees grow in one of two ways that give the same trees:

* **Waves.** All models grow in step. A wave is one aggregate over the rows, keyed by (model, node, column, bin), for the
  nodes of all models whose split is not known yet; the best split of each node is found where its sums meet, and
  one row per node comes to the driver. Margins are written every ``KEEP_ROUNDS`` rounds, so a lost executor repeats little.
* **Tasks.** A table of at most ``task_rows`` rows is dealt to one task for each model (boosting) or each ``CHUNK`` of trees
  (forests). Trees can't tell equal rows apart, so a larger table goes the same way once equal rows are counted (``counted_cells``),
  if it has at most ``task_rows`` different ones; how many of them a tree draws is counted over all rows before. In a larger
  forest, waves divide the large nodes and every node that has come under the bound is finished in a
  task. Only the order of work differs, never the rows.

Categories are split as such: codes by gradient over Hessian, best prefix of at most ``max_cat_threshold`` codes; or as
one-hot columns, one code against the rest. No value needs a bin or a matrix column of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.operators import growth
from cmdprism.operators.growth import UNIT, Cells, CountedCells, Growing, Layout, Split, Sums, TreeParams
from cmdprism.session import LABEL
from cmdprism.sources.tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that one task may hold to grow whole trees.
TASK_ROWS = 1 << 18
#: Bins of a number with more values than that.
MAX_BINS = 255
#: Rounds of boosting between two writes of the margins.
KEEP_ROUNDS = 8
#: Trees of a forest that one task grows.
CHUNK = 25
#: Draws (different rows x trees) that one task may hold.
TASK_DRAWS = 1 << 24
#: Different rows that a task keeps while it counts draws.
HELD_CELLS = 1 << 13
#: Codes of a category that meet in one group of a wave; more are cut down in parts first.
CATEGORY_ROWS = 1 << 16

TREE = "job int, tree int, node int, column int, cut int, codes array<int>, left int, right int, value double, cover double"
SPLITS = "job int, node int, gain double, column int, cut int, codes array<int>, left array<double>, total array<double>"
CELLS = "job int, node int, column int, code long, g long, h long, c long"


# ---- binned rows ---------------------------------------------------------------------------------------


def fit_layout(table: DataFrame, numbers: Sequence[str], categories: Sequence[str], sizes: dict[str, int]) -> Layout:
    """Bins of the numbers: their values, or quantiles where there are more than MAX_BINS. Two aggregates, and one for the quantiles if any."""
    doubles = [F.col(n).cast("double") for n in numbers]
    row = table.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(doubles)]).first()
    few = [i for i in range(len(numbers)) if (row[f"n{i}"] or 0) <= MAX_BINS * 5 // 4]
    sets = table.agg(F.count("*").alias("n"), *[F.collect_set(doubles[i]).alias(f"s{i}") for i in few]).first()
    many = [i for i in range(len(numbers)) if i not in few or not 0 < len(sets[f"s{i}"]) <= MAX_BINS]
    share = F.lit([(i + 1) / MAX_BINS for i in range(MAX_BINS)])
    ends = table.agg(*[F.percentile_approx(doubles[i], share, 10_000).alias(f"q{i}") for i in many]).first() if many else {}
    cuts = [tuple(sorted(set((ends[f"q{i}"] or [0.0]) if i in many else sets[f"s{i}"]))) for i in range(len(numbers))]
    return Layout(tuple(numbers), tuple(cuts), tuple(categories), tuple(sizes[c] + 1 for c in categories))


def with_bins(indexed: DataFrame, layout: Layout, key: Column, fold: Column) -> DataFrame:
    """(row, key, fold, label, x0, x1, ...) of rows with numbers and ``<category>_index``, written once."""
    names = [f"x{i}" for i in range(len(layout.numbers) + len(layout.categories))]
    cuts = [np.array(c) for c in layout.cuts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"row": batch["row"], "key": batch["key"], "fold": batch["fold"], "label": batch["label"]}
            for name, values, of in zip(names, (batch[f"n{i}"] for i in range(len(cuts))), cuts, strict=False):
                out[name] = np.minimum(np.searchsorted(of, values.to_numpy(), "left"), len(of) - 1).astype(np.int32)
            for k in range(len(layout.categories)):
                out[names[len(cuts) + k]] = batch[f"c{k}"].astype(np.int32)
            yield pd.DataFrame(out)

    staged = indexed.select(
        F.monotonically_increasing_id().alias("row"), key.alias("key"), fold.cast("int").alias("fold"), F.col(LABEL).cast("int").alias("label"),
        *[F.col(n).cast("double").alias(f"n{i}") for i, n in enumerate(layout.numbers)],
        *[F.col(f"{c}_index").cast("int").alias(f"c{k}") for k, c in enumerate(layout.categories)],
    )
    schema = "row long, key long, fold int, label int, " + ", ".join(f"{n} int" for n in names)
    return materialize(staged.mapInPandas(run, schema), "binned")


@dataclass
class Batch:
    """Arrays of some binned rows."""

    row: np.ndarray
    key: np.ndarray
    fold: np.ndarray
    y: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, layout: Layout) -> Batch:
        names = [f"x{i}" for i in range(len(layout.numbers) + len(layout.categories))]
        return cls(
            *(rows[c].to_numpy(np.int64) for c in ("row", "key")), *(rows[c].to_numpy(np.int32) for c in ("fold", "label")),
            np.ascontiguousarray(rows[names].to_numpy(np.int32)),
        )


def draws_rows(p: TreeParams) -> bool:
    """Whether trees see samples of the rows."""
    return p.forest or p.subsample < 1.0 and p.subsample_freq > 0


def counted_cells(binned: DataFrame, layout: Layout, p: TreeParams, chunks: list[range], task_rows: int) -> DataFrame | None:
    """Equal rows of a large table as one: (row, fold, label, n, x0, ...), where ``row`` numbers the different ones, and with samples
    ``draws``, one array per chunk of trees. None if they are too many for a task.

    Which rows a tree draws goes by their own keys, so it is counted row by row; a task adds up what it has seen first.
    """
    names = [f"x{i}" for i in range(len(layout.numbers) + len(layout.categories))]
    by = ["fold", "label", *names]
    cells = materialize(binned.groupBy(*by).agg(F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id()), "cells")
    most = max(c.stop for c in chunks)
    found = cells.count()
    if found > task_rows:
        return None
    if not draws_rows(p):
        return cells
    if found * most > TASK_DRAWS:
        return None
    wide = max(len(c) for c in chunks)
    drawn = [f"d{i}" for i in range(wide)]

    def frames(keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        for k, chunk in enumerate(chunks):
            out = pd.DataFrame(keys, columns=by)
            out["chunk"] = k
            padded = np.zeros((len(keys), wide), np.int64)
            padded[:, : len(chunk)] = counts[:, chunk.start : chunk.stop]
            yield pd.concat([out, pd.DataFrame(padded, columns=drawn)], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros((0, len(by)), np.int32), np.zeros((0, most))
        for rows in batches:
            key = rows["key"].to_numpy(np.int64)
            own, of_row = np.unique(rows[by].to_numpy(np.int32), axis=0, return_inverse=True)
            of_row = of_row.ravel()
            take = growth.drawn if p.forest else growth.sampled
            made = np.stack([np.bincount(of_row, take(p, t, key), len(own)) for t in range(most)], axis=1)
            keys, place = np.unique(np.concatenate([keys, own]), axis=0, return_inverse=True)
            total = np.zeros((len(keys), most))
            np.add.at(total, place.ravel(), np.concatenate([counts, made]))
            counts = total
            if len(keys) > HELD_CELLS:
                yield from frames(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from frames(keys, counts)

    schema = ", ".join(f"{c} int" for c in [*by, "chunk"]) + "".join(f", {d} long" for d in drawn)
    sums = binned.select("key", *by).mapInPandas(run, schema).groupBy(*by, "chunk").agg(*[F.sum(d).alias(d) for d in drawn])
    arrays = F.array_sort(F.collect_list(F.struct("chunk", F.array(*[F.col(d).cast("int") for d in drawn]).alias("d"))))
    per_cell = sums.groupBy(*by).agg(F.transform(arrays, lambda s: s["d"]).alias("draws"))
    return materialize(cells.join(per_cell, by), "cells")


def cells_of(rows: pd.DataFrame, layout: Layout, job: Job, chunks: list[range] | None = None) -> tuple[Cells, Batch]:
    """Cells of binned rows, or of a table of counted ones with the draws of ``chunks``."""
    batch = Batch.of(rows if "key" in rows else rows.assign(key=0), layout)
    train = job.train(batch.fold)
    if "n" not in rows:
        return Cells.of(batch.x, batch.y, train), batch
    draws = None
    if "draws" in rows:
        parts = [np.stack([d[: len(c)] for d in rows["draws"].map(lambda a, k=k: a[k])]) for k, c in enumerate(chunks)]
        draws = np.concatenate(parts, axis=1)
    n = rows["n"].to_numpy(np.int64)
    return CountedCells(batch.x, batch.y, train, np.arange(len(n)), n, draws, chunks[0].start if chunks else 0), batch


# ---- models to grow ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Job:
    """One model: how it grows, the fold that is held out (None: all rows count) and the weights of the classes."""

    p: TreeParams
    held: int | None
    zero: int
    one: int

    @property
    def weights(self) -> tuple[float, float]:
        w0 = w1 = 1.0
        if self.p.class_weight == "balanced":
            n = self.zero + self.one
            w0, w1 = (n / (2.0 * c) if c else 0.0 for c in (self.zero, self.one))
        elif self.p.class_weight == "positive":
            w1 = self.zero / max(self.one, 1)
        elif self.p.class_weight not in (None, "balanced_subsample"):
            raise ValueError(f"unknown class weight mode: {self.p.class_weight}")
        if self.p.scale_pos_weight is not None:
            w1 *= self.p.scale_pos_weight
        if self.p.is_unbalance and self.zero and self.one:
            w0 *= max(1.0, self.one / self.zero)
            w1 *= max(1.0, self.zero / self.one)
        return w0, w1

    @property
    def base(self) -> float:
        if self.p.forest:
            return 0.0
        return growth.base_margin(self.weights[0] * self.zero, self.weights[1] * self.one)

    def train(self, fold: np.ndarray) -> np.ndarray:
        return np.ones(len(fold), bool) if self.held is None else fold != self.held


def label_counts(binned: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows of class 0 and 1 per fold."""
    out: dict[int, tuple[int, int]] = {}
    for r in binned.groupBy("fold").agg(F.count_if(F.col("label") == 0).alias("zero"), F.count_if(F.col("label") == 1).alias("one")).collect():
        out[r["fold"]] = (r["zero"], r["one"])
    return out


def job_of(p: TreeParams, counts: dict[int, tuple[int, int]], held: int | None = None) -> Job:
    used = [c for fold, c in counts.items() if held is None or fold != held]
    return Job(p, held, sum(c[0] for c in used), sum(c[1] for c in used))


def dealt(binned: DataFrame, n_jobs: int, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, n_chunks: int = 1) -> DataFrame:
    """Every job gets all rows in a task of its own. Callers hold the number of rows under TASK_ROWS.

    With ``n_chunks`` jobs go through the chunks of a forest, and counted rows bring the draws of the job's chunk only.
    """
    jobs = F.explode(F.sequence(F.lit(0), F.lit(n_jobs - 1))).alias("job")
    rows = binned.select("*", jobs)
    if n_chunks > 1 and "draws" in binned.columns:
        rows = rows.withColumn("draws", F.array(F.get("draws", F.col("job") % n_chunks)))
    return rows.repartition(n_jobs, "job").groupBy("job").applyInPandas(run, schema)


def tree_table(trees: list[tuple[int, dict[str, list]]], job: int) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"job": job, "tree": t, **made}) for t, made in trees])


def boosted_in_tasks(binned: DataFrame, layout: Layout, jobs: list[Job]) -> DataFrame:
    """The trees of every job, as rows of TREE."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["job"].iloc[0])
        job = jobs[at]
        cells, batch = cells_of(rows, layout, job, chunks_of(job.p))
        _, trees, _ = growth.boost(cells, batch.key, job.weights, layout, job.p)
        return tree_table(list(enumerate(trees)), at)

    return dealt(binned, len(jobs), run, TREE)


def chunks_of(p: TreeParams) -> list[range]:
    return [range(i, min(i + CHUNK, p.n_estimators)) for i in range(0, p.n_estimators, CHUNK)]


def forest_in_tasks(binned: DataFrame, layout: Layout, job: Job) -> DataFrame:
    """The trees of a forest, as rows of TREE."""
    chunks = chunks_of(job.p)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = chunks[int(rows["job"].iloc[0])]
        cells, batch = cells_of(rows, layout, job, [chunk])
        grown = [(t, growth.forest_tree(cells, batch.key, job.weights, layout, job.p, t)[0]) for t in chunk]
        return tree_table([(t, tree.finished(1.0)[0]) for t, tree in grown], 0)

    return dealt(binned, len(chunks), run, TREE, len(chunks))


# ---- growing in waves ---------------------------------------------------------------------------------------


@dataclass
class Lane:
    """One model that grows in step with others: its tree under construction, and trees not yet in the written margins."""

    job: Job
    tree: Growing | None = None
    recent: list[tuple[Growing, np.ndarray, np.ndarray]] = field(default_factory=list)
    weights: tuple[float, float] = (1.0, 1.0)

    def margin(self, written: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = written
        for tree, values, leaf_of in self.recent:
            out = out + values[leaf_of[tree.walk(x)]]
        return out

    def stats(self, batch: Batch, written: np.ndarray | None) -> np.ndarray:
        p, train = self.job.p, self.job.train(batch.fold)
        if p.forest:
            return growth.shares(batch.y, self.weights, growth.drawn(p, self.tree.tree, batch.key) * train)
        weight = np.where(batch.y > 0, self.weights[1], self.weights[0])
        used = train & growth.sampled(p, self.tree.tree, batch.key)
        return growth.gradients(self.margin(written, batch.x), batch.y, weight, used.astype(np.float64))


def number_cells(job: int, nodes: list[int], sums: Sums, layout: Layout) -> pd.DataFrame:
    """Filled bins of the numbers as rows of CELLS."""
    slot, at = np.nonzero(sums.numbers[2])
    column = np.searchsorted(layout.starts, at, "right") - 1
    g, h, c = (s[slot, at].astype(np.int64) for s in sums.numbers)
    return pd.DataFrame({"job": job, "node": np.array(nodes)[slot], "column": column, "code": at - layout.starts[column], "g": g, "h": h, "c": c})


def category_cells(job: int, nodes: list[int], sums: Sums, layout: Layout) -> Iterator[pd.DataFrame]:
    for k, (slot, code, found) in enumerate(sums.categories):
        g, h, c = found.astype(np.int64).T
        yield pd.DataFrame(
            {"job": job, "node": np.array(nodes)[slot], "column": len(layout.numbers) + k, "code": code, "g": g, "h": h, "c": c}
        )


def wave_sums(rows: DataFrame, layout: Layout, lanes: dict[int, Lane], nodes: dict[int, list[int]]) -> DataFrame:
    """Histograms of ``nodes`` of every lane, one aggregate: a task adds up its numbers first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for rows in batches:
            batch = Batch.of(rows, layout)
            for j, own in nodes.items():
                lane = lanes[j]
                written = rows[f"m{j}"].to_numpy(np.float64) if f"m{j}" in rows else np.full(len(rows), lane.job.base)
                stats = lane.stats(batch, written)
                slot_of = np.full(len(lane.tree.left), -1)
                slot_of[own] = np.arange(len(own))
                slots = slot_of[lane.tree.walk(batch.x)]
                live = np.flatnonzero((slots >= 0) & (stats[:, 2] > 0))
                sums = growth.sums_of(batch.x[live], slots[live], len(own), stats[live], layout)
                held[j] = [a + b for a, b in zip(held[j], sums.numbers, strict=True)] if j in held else sums.numbers
                yield from category_cells(j, own, sums, layout)
        for j, numbers in held.items():
            yield number_cells(j, nodes[j], Sums(numbers, [], np.zeros((0, 3))), layout)

    cells = rows.mapInPandas(run, CELLS).groupBy("job", "node", "column", "code")
    return cells.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c"))


def node_sums(cells: pd.DataFrame, layout: Layout, totals: np.ndarray | None = None) -> Sums:
    """Rows of CELLS of one node as its histogram."""
    wide, starts = len(layout.numbers), layout.starts
    column, code = cells["column"].to_numpy(), cells["code"].to_numpy()
    stats = cells[["g", "h", "c"]].to_numpy(np.float64)
    number = column < wide
    at = starts[column[number]] + code[number]
    numbers = [np.bincount(at, s, int(starts[-1])).reshape(1, -1) for s in stats[number].T]
    if totals is None:
        totals = np.array([[s[0, : starts[1]].sum() for s in numbers]])
    categories = []
    for k in range(len(layout.categories)):
        own = np.flatnonzero(column == wide + k)
        own = own[np.argsort(code[own])]
        categories.append((np.zeros(len(own), np.int64), code[own], stats[own]))
    return Sums(numbers, categories, totals)


def wave_splits(rows: DataFrame, layout: Layout, lanes: dict[int, Lane], nodes: dict[int, list[int]]) -> dict[tuple[int, int], tuple]:
    """(total, best split) of every pending node."""
    sums = wave_sums(rows, layout, lanes, nodes)
    about = {(j, i): (lanes[j].job.p, lanes[j].tree.tree, lanes[j].tree.uid[i]) for j, own in nodes.items() for i in own}
    if max(layout.sizes, default=0) > CATEGORY_ROWS:
        sums = cut_categories(materialize(sums, "wave"), layout, about)

    def best(cells: pd.DataFrame) -> pd.DataFrame:
        key = (int(cells["job"].iloc[0]), int(cells["node"].iloc[0]))
        p, tree, uid = about[key]
        own = node_sums(cells, layout)
        split = growth.best_splits(own, p, layout, tree, np.array([uid], np.uint64))[0]
        none = split is None
        return pd.DataFrame(
            {
                "job": [key[0]], "node": [key[1]], "gain": [np.nan if none else split.gain], "column": [-1 if none else split.column],
                "cut": [-1 if none else split.cut], "codes": [[] if none else list(split.codes)],
                "left": [[] if none else list(split.left)], "total": [own.totals[0].tolist()],
            }
        )

    out = {}
    for r in sums.groupBy("job", "node").applyInPandas(best, SPLITS).collect():
        split = None if r["column"] < 0 else Split(r["gain"], r["column"], r["cut"], tuple(r["codes"]), tuple(r["left"]))
        out[r["job"], r["node"]] = (tuple(r["total"]), split)
    return out


def cut_categories(sums: DataFrame, layout: Layout, about: dict) -> DataFrame:
    """Only the codes that can make a node's best split, found in parts of bounded size: ends of the order, or single best codes.

    ``sums`` is a written table, from which the nodes' totals are read first.
    """
    wide = len(layout.numbers)
    first = sums.where(F.col("column") == 0).groupBy("job", "node").agg(*[F.sum(c).alias(c) for c in "ghc"])
    totals = {(r["job"], r["node"]): np.array([[r["g"], r["h"], r["c"]]], np.float64) for r in first.collect()}

    def cut(cells: pd.DataFrame) -> pd.DataFrame:
        key = (int(cells["job"].iloc[0]), int(cells["node"].iloc[0]))
        p, tree, uid = about[key]
        cells = cells.sort_values("code")
        stats, code = cells[["g", "h", "c"]].to_numpy(np.float64), cells["code"].to_numpy()
        if p.native_categories:
            ratio = stats[:, 0] / (stats[:, 1] + p.cat_smooth * UNIT)
            most = p.max_cat_threshold
            kept = np.union1d(np.lexsort((code, ratio))[:most], np.lexsort((code, -ratio))[:most])
        else:
            gain = growth.gains(list(stats.T), np.repeat(totals[key], len(code), axis=0), p, p.reg_lambda)
            column = int(cells["column"].iloc[0])
            u, drawn = growth.drawn_columns(p, layout, tree, (column + 1) * (1 << 32) + code, np.full(len(code), uid, np.uint64))
            valid = np.isfinite(gain)
            taken = np.lexsort((code, -np.where(valid & drawn, gain, -np.inf)))[:1]
            kept = np.union1d(taken, np.lexsort((code, np.where(valid, u, np.inf)))[:1])
        return cells.iloc[np.sort(kept)].drop(columns="part")

    parts = max(layout.sizes) // CATEGORY_ROWS + 1
    categories = sums.where(F.col("column") >= wide).withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)))
    return sums.where(F.col("column") < wide).unionByName(categories.groupBy("job", "node", "column", "part").applyInPandas(cut, CELLS))


def grow_waves(rows: DataFrame, layout: Layout, lanes: dict[int, Lane], least: float = 0.0) -> None:
    """Grow the current tree of every lane until no node of more than ``least`` rows is pending."""
    while True:
        nodes = {
            j: own
            for j, lane in lanes.items()
            if (own := [i for i in lane.tree.pending if i == 0 and lane.tree.totals[0][2] == 0 or lane.tree.totals[i][2] / UNIT > least])
        }
        if not nodes:
            return
        found = wave_splits(rows, layout, lanes, nodes)
        for j, own in nodes.items():
            tree = lanes[j].tree
            if own == [0]:
                tree.totals[0] = found.get((j, 0), ((0.0, 0.0, 0.0), None))[0]
            tree.take(own, [found.get((j, i), (None, None))[1] for i in own])


def write_margins(rows: DataFrame, layout: Layout, lanes: dict[int, Lane]) -> DataFrame:
    """The binned rows with the margins of all lanes, recent trees included."""
    plain = [c for c in rows.columns if not c.startswith("m")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = Batch.of(batch, layout).x
            out = batch[plain].copy()
            for j, lane in lanes.items():
                written = batch[f"m{j}"].to_numpy(np.float64) if f"m{j}" in batch else np.full(len(x), lane.job.base)
                out[f"m{j}"] = lane.margin(written, x)
            yield out

    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*plain).dtypes) + "".join(f", m{j} double" for j in lanes)
    # Written while the lanes still hold the trees that the functions take along.
    kept = materialize(rows.mapInPandas(run, schema), "margins")
    for lane in lanes.values():
        lane.recent = []
    return kept


def boosted_in_waves(binned: DataFrame, layout: Layout, jobs: list[Job]) -> tuple[list[list[dict]], DataFrame]:
    """Trees of every job, and the rows with the final margin of each (``m<job>``)."""
    lanes = {j: Lane(job, weights=job.weights) for j, job in enumerate(jobs)}
    trees: list[list[dict]] = [[] for _ in jobs]
    rows = binned
    for t in range(max(job.p.n_estimators for job in jobs)):
        growing = {j: lane for j, lane in lanes.items() if t < lane.job.p.n_estimators}
        for lane in growing.values():
            lane.tree = Growing.root(lane.job.p, t)
        grow_waves(rows, layout, growing)
        for j, lane in growing.items():
            rate = lane.job.p.learning_rate
            made, leaf_of = lane.tree.finished(rate)
            trees[j].append(made)
            lane.recent.append((lane.tree, lane.tree.values(rate), leaf_of))
        if (t + 1) % KEEP_ROUNDS == 0:
            rows = write_margins(rows, layout, lanes)
    return trees, write_margins(rows, layout, lanes)


def forest_in_waves(binned: DataFrame, layout: Layout, job: Job, task_rows: int) -> list[tuple[int, dict[str, list]]]:
    """A forest whose large nodes are divided in waves; nodes of at most ``task_rows`` rows are finished in tasks."""
    out = []
    for chunk in chunks_of(job.p):
        lanes = {t: Lane(job, Growing.root(job.p, t), weights=job.weights) for t in chunk}
        if job.p.class_weight == "balanced_subsample":
            for t, counts in drawn_counts(binned, layout, job, list(chunk)).items():
                lanes[t].weights = growth.subsample_weights(*counts)
        grow_waves(binned, layout, lanes, task_rows)
        finished = finish_nodes(binned, layout, lanes)
        for t, lane in lanes.items():
            out.append((t, grafted(lane.tree, finished.get(t, {}))))
    return out


def drawn_counts(binned: DataFrame, layout: Layout, job: Job, trees: list[int]) -> dict[int, tuple[float, float]]:
    """Rows of each class in the bootstrap samples of some trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            batch = Batch.of(rows, layout)
            for t in trees:
                count = growth.drawn(job.p, t, batch.key) * job.train(batch.fold)
                yield pd.DataFrame({"tree": [t], "zero": [float(count[batch.y == 0].sum())], "one": [float(count[batch.y == 1].sum())]})

    sums = binned.mapInPandas(run, "tree int, zero double, one double").groupBy("tree").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    return {r["tree"]: (r["zero"], r["one"]) for r in sums.collect()}


def finish_nodes(binned: DataFrame, layout: Layout, lanes: dict[int, Lane]) -> dict[int, dict[int, pd.DataFrame]]:
    """Subtrees of all pending nodes: each node's rows meet in one task, which the bound on pending nodes keeps small."""
    names = [f"x{i}" for i in range(len(layout.numbers) + len(layout.categories))]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            batch = Batch.of(rows, layout)
            for t, lane in lanes.items():
                node_of = lane.tree.walk(batch.x)
                stats = lane.stats(batch, None)
                live = np.flatnonzero(np.isin(node_of, lane.tree.pending) & (stats[:, 2] > 0))
                if len(live):
                    out = pd.DataFrame(batch.x[live], columns=names)
                    out["tree"], out["node"] = t, node_of[live]
                    for name, s in zip("ghc", stats[live].T, strict=True):
                        out[name] = s.astype(np.int64)
                    yield out

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        t, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        above = lanes[t].tree
        tree = Growing.root(above.p, t, above.uid[node], above.depth[node])
        growth.grow(rows[names].to_numpy(np.int32), rows[["g", "h", "c"]].to_numpy(np.float64), layout, tree)
        made, _ = tree.finished(1.0)
        return pd.DataFrame({"job": node, "tree": t, **made})

    schema = "tree int, node int, g long, h long, c long, " + ", ".join(f"{n} int" for n in names)
    columns = schema.replace(" int", "").replace(" long", "").split(", ")
    found: dict[int, dict[int, pd.DataFrame]] = {}
    table = binned.mapInPandas(lambda b: (o[columns] for o in spread(b)), schema).groupBy("tree", "node").applyInPandas(finish, TREE).toPandas()
    for (t, node), rows in table.groupby(["tree", "job"]):
        found.setdefault(int(t), {})[int(node)] = rows.sort_values("node")
    return found


def grafted(tree: Growing, subtrees: dict[int, pd.DataFrame]) -> dict[str, list]:
    """A tree with its finished subtrees in the place of the pending nodes."""
    out, _ = tree.finished(1.0)
    # finished() numbers nodes from the root, left before right; follow it to find the pending ones.
    at, stack = {}, [(0, 0)]
    while stack:
        own, number = stack.pop()
        at[own] = number
        if out["left"][number] >= 0:
            stack += [(tree.left[own], out["left"][number]), (tree.left[own] + 1, out["right"][number])]
    for own, rows in subtrees.items():
        number, offset = at[own], len(out["node"]) - 1
        place = lambda i, number=number, offset=offset: number if i == 0 else -1 if i < 0 else i + offset
        for r in rows.itertuples():
            made = {
                "node": place(r.node), "column": r.column, "cut": r.cut, "codes": list(r.codes), "left": place(r.left),
                "right": place(r.right), "value": r.value, "cover": r.cover,
            }
            for c, v in made.items():
                if r.node == 0:
                    out[c][number] = v
                else:
                    out[c].append(v)
    return out


# ---- fitting ------------------------------------------------------------------------------------------------


def fit(binned: DataFrame, layout: Layout, p: TreeParams, task_rows: int = TASK_ROWS) -> tuple[float, pd.DataFrame]:
    """Base margin and node table (rows of TREE) of one model over all rows."""
    job = job_of(p, label_counts(binned))
    if job.zero + job.one == 0:
        raise ValueError("no labeled rows available")
    rows = binned if job.zero + job.one <= task_rows else counted_cells(binned, layout, p, chunks_of(p), task_rows)
    if rows is not None:
        grown = forest_in_tasks(rows, layout, job) if p.forest else boosted_in_tasks(rows, layout, [job])
        return job.base, grown.toPandas().sort_values(["tree", "node"], ignore_index=True)
    if p.forest:
        made = forest_in_waves(binned, layout, job, task_rows)
    else:
        made = list(enumerate(boosted_in_waves(binned, layout, [job])[0][0]))
    return job.base, tree_table(made, 0).sort_values(["tree", "node"], ignore_index=True)


def held_predictions(binned: DataFrame, layout: Layout, points: list[TreeParams], folds: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(point, fold, label, prediction, n): classes that each point's model gives the rows of the fold it has not seen."""
    counts = label_counts(binned)
    small = sum(z + o for z, o in counts.values()) <= task_rows
    if points[0].forest:
        return _forest_predictions(binned, layout, points, folds, counts, small, task_rows)
    jobs = [job_of(p, counts, fold) for p in points for fold in range(folds)]
    longest = max(points, key=lambda p: p.n_estimators)
    table = binned if small else None
    if not small and len({(p.random_state, p.subsample, p.subsample_freq) if draws_rows(p) else None for p in points}) == 1:
        table = counted_cells(binned, layout, longest, chunks_of(longest), task_rows)
    if table is not None:

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            at = int(rows["job"].iloc[0])
            job = jobs[at]
            cells, batch = cells_of(rows, layout, job, chunks_of(longest))
            _, _, margin = growth.boost(cells, batch.key, job.weights, layout, job.p)
            held = ~job.train(batch.fold)
            n = rows["n"].to_numpy()[held] if "n" in rows else 1
            hit = pd.DataFrame({"label": batch.y[held], "prediction": (margin[cells.of_row[held]] > 0).astype(int), "n": n})
            return hit.groupby(["label", "prediction"])["n"].sum().reset_index().assign(job=at)[["job", "label", "prediction", "n"]]

        found = dealt(table, len(jobs), run, "job int, label int, prediction int, n long")
    else:
        _, rows = boosted_in_waves(binned, layout, jobs)
        each = F.array(*[F.struct(F.lit(j).alias("job"), F.col(f"m{j}").alias("margin")) for j in range(len(jobs))])
        spread = rows.select("fold", "label", F.inline(each)).where(F.col("fold") == F.col("job") % folds)
        found = spread.groupBy("job", "label", (F.col("margin") > 0).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return found.select(F.expr(f"job div {folds}").cast("int").alias("point"), (F.col("job") % folds).alias("fold"), "label", "prediction", "n")


def _forest_predictions(
    binned: DataFrame, layout: Layout, points: list[TreeParams], folds: int, counts: dict, small: bool, task_rows: int
) -> DataFrame:
    """Points share their trees: a forest of fewer trees is the first part of a larger one, and a depth limit cuts the same trees."""
    depths = sorted({p.max_depth for p in points}, key=lambda d: (d is not None, d))
    most = max(p.n_estimators for p in points)
    widest = TreeParams(**{**points[0].__dict__, "n_estimators": most, "max_depth": None if None in depths else max(depths)})
    jobs = [job_of(widest, counts, fold) for fold in range(folds)]
    # Chunks end where a point's forest ends.
    ends = sorted({*range(CHUNK, most, CHUNK), *[p.n_estimators for p in points]})
    chunks = [range(a, b) for a, b in zip([0, *ends], ends, strict=False)]
    units = [(fold, chunk) for fold in range(folds) for chunk in range(len(chunks))]

    def cut_values(tree: Growing, depth: int | None) -> np.ndarray:
        """Value of each created node's ancestor at the depth limit."""
        values = tree.values(1.0)
        if depth is not None:
            for i in range(len(values)):
                if tree.left[i] >= 0 and tree.depth[i] >= depth:
                    values[tree.left[i]] = values[tree.left[i] + 1] = values[i]
        return values

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        fold, chunk = units[int(rows["job"].iloc[0])]
        cells, batch = cells_of(rows, layout, jobs[fold], [chunks[chunk]])
        train = jobs[fold].train(batch.fold)
        totals = np.zeros((len(depths), len(cells.y)))
        for t in chunks[chunk]:
            tree, node_of = growth.forest_tree(cells, batch.key, jobs[fold].weights, layout, widest, t)
            for d, depth in enumerate(depths):
                totals[d] += cut_values(tree, depth)[node_of]
        held = np.flatnonzero(~train)
        n = rows["n"].to_numpy(np.int64)[held] if "n" in rows else 1
        out = {"row": batch.row[held], "fold": fold, "label": batch.y[held], "n": n, "chunk": chunk}
        return pd.concat([pd.DataFrame({**out, "depth": d, "total": totals[d][cells.of_row[held]]}) for d in range(len(depths))])

    table = binned if small else counted_cells(binned, layout, widest, chunks, task_rows)
    if table is not None:
        parts = dealt(table, len(units), summed, "row long, fold int, label int, n long, chunk int, depth int, total double", len(chunks))
        parts = materialize(parts, "held-votes")
        found = []
        for k, p in enumerate(points):
            own = parts.where((F.col("depth") == depths.index(p.max_depth)) & (F.col("chunk") < ends.index(p.n_estimators) + 1))
            votes = own.groupBy("row", "fold", "label", "n").agg((F.sum("total") / p.n_estimators).alias("share"))
            found.append(votes.select(F.lit(k).alias("point"), "fold", "label", (F.col("share") > 0.5).cast("int").alias("prediction"), "n"))
    else:
        found = []
        for k, p in enumerate(points):
            for fold in range(folds):
                made = forest_in_waves(binned, layout, job_of(p, counts, fold), task_rows)
                rows = binned.where(F.col("fold") == fold)
                shares = binned_shares(rows, layout, tree_table(made, 0), p.n_estimators)
                found.append(shares.select(F.lit(k).alias("point"), "fold", "label", (F.col("share") > 0.5).cast("int").alias("prediction"), F.lit(1).alias("n")))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.groupBy("point", "fold", "label", "prediction").agg(F.sum("n").alias("n"))


def binned_shares(rows: DataFrame, layout: Layout, nodes: pd.DataFrame, n_trees: int) -> DataFrame:
    """Mean leaf value over a forest's trees for binned rows."""
    trees = [t.reset_index(drop=True) for _, t in nodes.sort_values(["tree", "node"]).groupby("tree")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = Batch.of(batch, layout).x
            total = np.zeros(len(x))
            for t in trees:
                node = np.zeros(len(x), np.int64)
                column, cut, left, right = (t[c].to_numpy() for c in ("column", "cut", "left", "right"))
                while True:
                    live = np.flatnonzero(left[node] >= 0)
                    if not len(live):
                        break
                    at = node[live]
                    value = x[live, column[at]]
                    goes = value <= cut[at]
                    for i in np.unique(at):
                        if len(t["codes"][i]):
                            goes[at == i] = np.isin(value[at == i], t["codes"][i])
                    node[live] = np.where(goes, left[at], right[at])
                total += t["value"].to_numpy()[node]
            yield pd.DataFrame({"fold": batch["fold"], "label": batch["label"], "share": total / n_trees})

    return rows.mapInPandas(run, "fold int, label int, share double")


# ---- fitted models --------------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Fitted trees over raw columns: all nodes in one table, children by number, categories by their values."""

    numbers: list[str]
    categories: list[str]
    base: float
    forest: bool
    nodes: pd.DataFrame  # tree, node, column, threshold, values, left, right, value, cover; rows by (tree, node)

    def __post_init__(self) -> None:
        self._walker: Walker | None = None

    @property
    def walker(self) -> Walker:
        if self._walker is None:
            self._walker = Walker(self)
        return self._walker

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree"].max()) + 1 if len(self.nodes) else 0

    def inputs(self) -> list[Column]:
        """The columns that a scoring function takes: all numbers as one array, and the categories' values."""
        numbers = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.numbers])
        return [numbers, *[F.coalesce(F.col(c), F.lit("unknown")) for c in self.categories]]

    def probability(self) -> Column:
        """Probability of class 1, in Arrow batches; works on streams as well."""
        walker = self.walker

        @F.pandas_udf("double")
        def score(numbers: pd.Series, *categories: pd.Series) -> pd.Series:
            return pd.Series(walker.probability(*walker.arrays(numbers, categories)))

        return score(*self.inputs())

    def table(self, spark: SparkSession) -> DataFrame:
        """The node table, for saving and for queries."""
        schema = "tree int, node int, column string, threshold double, values array<string>, left int, right int, value double, cover double"
        return spark.createDataFrame(self.nodes, schema)


def model_of(base: float, made: pd.DataFrame, layout: Layout, p: TreeParams, tables: dict[str, DataFrame]) -> TreeModel:
    """The fitted model; codes in its splits become values by a join with the category tables."""
    wide = len(layout.numbers)
    names = [*layout.numbers, *layout.categories]
    used: dict[str, dict[int, str]] = {}
    for k, category in enumerate(layout.categories):
        codes = sorted({int(c) for row in made.loc[made["column"] == wide + k, "codes"] for c in row})
        if codes:
            wanted = tables[category].sparkSession.createDataFrame([(float(c),) for c in codes], "index double")
            found = tables[category].join(F.broadcast(wanted) if len(codes) <= CATEGORY_ROWS else wanted, "index").collect()
            used[category] = {int(r["index"]): r["value"] for r in found}
    column, cut = made["column"].to_numpy(), made["cut"].to_numpy()
    threshold = [layout.cuts[c][b] if 0 <= c < wide and b >= 0 else np.nan for c, b in zip(column, cut, strict=True)]
    values = [[used[names[c]][int(v)] for v in codes if int(v) in used[names[c]]] if c >= wide else [] for c, codes in zip(column, made["codes"], strict=True)]
    nodes = pd.DataFrame(
        {
            "tree": made["tree"].to_numpy(), "node": made["node"].to_numpy(), "column": [names[c] if c >= 0 else None for c in column],
            "threshold": threshold, "values": values, "left": made["left"].to_numpy(), "right": made["right"].to_numpy(),
            "value": made["value"].to_numpy(), "cover": made["cover"].to_numpy(),
        }
    )
    return TreeModel(list(layout.numbers), list(layout.categories), base, p.forest, nodes)


class Walker:
    """The node table as arrays, for batches of rows."""

    #: Rows that are walked at a time.
    STEP = 4096

    def __init__(self, model: TreeModel) -> None:
        nodes = model.nodes.sort_values(["tree", "node"], ignore_index=True)
        self.model_base, self.forest, self.wide = model.base, model.forest, len(model.numbers)
        names = [*model.numbers, *model.categories]
        place = {n: i for i, n in enumerate(names)}
        first = nodes.groupby("tree")["node"].transform("size")
        tree = nodes["tree"].to_numpy()
        self.roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
        offset = np.repeat(self.roots, np.diff(np.r_[self.roots, len(tree)])) if len(tree) else first.to_numpy()
        left, right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
        own = np.arange(len(nodes))
        self.inner = left >= 0
        self.left = np.where(self.inner, left + offset, own)
        self.right = np.where(self.inner, right + offset, own)
        self.column = np.array([place[c] if isinstance(c, str) else 0 for c in nodes["column"]], np.int64)
        self.threshold = nodes["threshold"].to_numpy(np.float64)
        self.value, self.cover = nodes["value"].to_numpy(np.float64), nodes["cover"].to_numpy(np.float64)
        self.by_value = self.inner & (self.column >= self.wide)
        # Values of each category that any split names get codes; a node's values are keys (node, code).
        self.codes: list[dict[str, int]] = [{} for _ in model.categories]
        keys = []
        for i in np.flatnonzero(self.by_value):
            known = self.codes[self.column[i] - self.wide]
            keys += [(int(i) << 32) + known.setdefault(v, len(known)) for v in nodes["values"].iloc[i]]
        self.keys = np.sort(np.array(keys, np.int64))

    def arrays(self, numbers: pd.Series, categories: Sequence[pd.Series]) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(numbers.to_numpy()).astype(np.float64) if len(numbers) else np.zeros((0, self.wide))
        unseen = (1 << 32) - 1
        codes = [s.map(known).fillna(unseen).to_numpy(np.int64) for s, known in zip(categories, self.codes, strict=True)]
        return x, np.stack(codes, axis=1) if codes else np.zeros((len(x), 0), np.int64)

    def goes_left(self, at: np.ndarray, rows: np.ndarray, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For pairs of an inner node and a row."""
        column = self.column[at]
        number = column < self.wide
        out = np.zeros(len(at), bool)
        out[number] = x[rows[number], column[number]] <= self.threshold[at[number]]
        named = np.flatnonzero(~number)
        if len(named) and len(self.keys):
            key = (at[named] << 32) + codes[rows[named], column[named] - self.wide]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[named] = self.keys[found] == key
        return out

    def leaves(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        n, trees = len(x), len(self.roots)
        node = np.tile(self.roots, n)
        rows = np.repeat(np.arange(n), trees)
        live = np.flatnonzero(self.inner[node])
        while len(live):
            at = node[live]
            node[live] = np.where(self.goes_left(at, rows[live], x, codes), self.left[at], self.right[at])
            live = live[self.inner[node[live]]]
        return node.reshape(n, trees)

    def margin(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Sum of the base and all leaf values, or the forest's mean share. Equal rows are walked once."""
        if not len(x) or not len(self.roots):
            return np.full(len(x), self.model_base)
        _, first, of_row = np.unique(np.column_stack([x, codes.astype(np.float64)]), axis=0, return_index=True, return_inverse=True)
        out = np.empty(len(first))
        for begin in range(0, len(first), self.STEP):
            own = first[begin : begin + self.STEP]
            found = self.value[self.leaves(x[own], codes[own])]
            out[begin : begin + self.STEP] = found.mean(axis=1) if self.forest else self.model_base + found.sum(axis=1)
        return out[of_row.ravel()]

    def probability(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        margin = self.margin(x, codes)
        return margin if self.forest else 1.0 / (1.0 + np.exp(-margin))

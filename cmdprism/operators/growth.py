"""Growth of one decision tree from histograms: split search, growth order, row hashes. Small numpy steps that run inside tasks.

Columns are binned once (``Layout``): numbers to bins, categories to codes. A node's histogram holds per bin the sums of
gradients and Hessians and the number of rows. All sums are whole numbers (parts of ``1 / UNIT``), so they don't
depend on the order of rows or tasks, and a tree is the same however its rows were dealt.

A split's gain is ``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)``. With gradients of a loss this is second-order boosting; with
``G`` = weight of the positives, ``H`` = weight and ``l`` = 0 it is the decrease of Gini impurity that forests use.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle

# Functions that run inside tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 20)
NO_SPLIT = -np.inf


@dataclass(frozen=True)
class TreeParams:
    """How trees are grown. ``num_leaves`` None: level by level; ``max_depth`` None: without limit."""

    n_estimators: int = 300
    learning_rate: float = 0.05
    num_leaves: int | None = 31
    max_depth: int | None = None
    reg_lambda: float = 0.0
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    subsample: float = 1.0
    subsample_freq: int = 0
    colsample_bytree: float = 0.8
    native_categories: bool = True
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    max_cat_threshold: int = 32
    forest: bool = False
    class_weight: str | None = None
    scale_pos_weight: float | None = None
    is_unbalance: bool = False
    random_state: int = 13


@dataclass(frozen=True)
class Layout:
    """The binned columns: numbers with the upper value of each bin, then categories with their number of codes."""

    numbers: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    categories: tuple[str, ...]
    sizes: tuple[int, ...]

    @property
    def starts(self) -> np.ndarray:
        """First place of each number's bins in a node's histogram; the end comes last."""
        return np.concatenate([[0], np.cumsum([len(c) for c in self.cuts])]).astype(np.int64)

    @property
    def columns(self) -> int:
        """Columns of the one-hot matrix."""
        return len(self.numbers) + sum(self.sizes)


# ---- hashes in place of random numbers --------------------------------------------------------


def mix(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers or arrays of them."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            z = (np.asarray(part).astype(np.int64).view(np.uint64) ^ out) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            out = z ^ (z >> np.uint64(32))
    return out


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) from a hash."""
    return (mix(*parts) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson_counts(u: np.ndarray) -> np.ndarray:
    """Counts of mean 1 for uniform numbers: how often a row is drawn into a bootstrap sample."""
    bounds = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    return np.searchsorted(bounds, u, "right")


# ---- histograms ----------------------------------------------------------------------------------


@dataclass
class Sums:
    """Histograms of some nodes: (nodes, bins) for the numbers, and one row per node and code for each category."""

    numbers: list[np.ndarray]  # g, h, rows
    categories: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # node, code, (rows, 3) of g, h, rows
    totals: np.ndarray  # (nodes, 3)


def sums_of(x: np.ndarray, slots: np.ndarray, n_slots: int, stats: np.ndarray, layout: Layout) -> Sums:
    """Histograms of ``n_slots`` nodes; ``slots`` says which node a row of ``x`` is in, ``stats`` (rows, 3) are g, h, rows."""
    wide, bins = len(layout.numbers), int(layout.starts[-1])
    at = (x[:, :wide] + layout.starts[:-1] + (slots * bins)[:, None]).ravel()
    numbers = [np.bincount(at, np.repeat(s, wide), n_slots * bins).reshape(n_slots, bins) for s in stats.T]
    totals = np.stack([np.bincount(slots, s, n_slots) for s in stats.T], axis=1)
    categories = []
    for k, size in enumerate(layout.sizes):
        key = slots.astype(np.int64) * size + x[:, wide + k]
        if n_slots * size <= 4 * len(key) + 4096:
            dense = np.stack([np.bincount(key, s, n_slots * size) for s in stats.T], axis=1)
            present = np.flatnonzero(dense[:, 2])
            found = dense[present]
        else:
            present, inverse = np.unique(key, return_inverse=True)
            found = np.stack([np.bincount(inverse, s, len(present)) for s in stats.T], axis=1)
        categories.append((present // size, present % size, found))
    return Sums(numbers, categories, totals)


# ---- split search -----------------------------------------------------------------------------------


@dataclass
class Split:
    """A node's best split: rows whose bin is at most ``cut``, or whose code is in ``codes``, go left."""

    gain: float
    column: int
    cut: int
    codes: tuple[int, ...]
    left: tuple[float, float, float]  # g, h, rows in units


def side_gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + l2 > 0, g * g / (h + l2), 0.0)


def gains(left: list[np.ndarray], totals: np.ndarray, p: TreeParams, l2: float) -> np.ndarray:
    """Gain of splits with the given left sums; NO_SPLIT where a side is too small."""
    gl, hl, nl = left[0] / UNIT, left[1] / UNIT, left[2] / UNIT
    g, h, n = (totals[..., i] / UNIT for i in range(3))
    gain = side_gain(gl, hl, l2) + side_gain(g - gl, h - hl, l2) - side_gain(g, h, p.reg_lambda)
    least = 0.5 if p.forest else max(p.min_child_samples, 1) - 0.5
    weight = 0.0 if p.forest else p.min_child_weight
    fits = (nl > least) & (n - nl > least) & (hl >= weight) & (h - hl >= weight)
    return np.where(fits, gain, NO_SPLIT)


def drawn_columns(p: TreeParams, layout: Layout, tree: int, columns: np.ndarray, uids: np.ndarray | None) -> np.ndarray:
    """Hash of each column for a tree, or for a node of a forest's tree, and whether it is drawn, as (hash, drawn)."""
    if p.forest:
        u = uniform(p.random_state, tree, uids.view(np.int64), columns)
        return u, u < max(1.0, np.sqrt(layout.columns)) / layout.columns
    u = uniform(p.random_state, tree, columns)
    return u, u < p.colsample_bytree


def category_runs(node: np.ndarray, code: np.ndarray, found: np.ndarray, totals: np.ndarray, p: TreeParams, down: bool):
    """Codes by gradient over Hessian, and the gain of every prefix of at most ``max_cat_threshold`` codes of a node."""
    ratio = found[:, 0] / (found[:, 1] + p.cat_smooth * UNIT)
    order = np.lexsort((code, -ratio if down else ratio, node))
    node, code, found = node[order], code[order], found[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    run = np.cumsum(np.r_[False, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    total = np.cumsum(found, axis=0)
    before = np.vstack([np.zeros((1, 3)), total])[first][run]
    left = total - before
    place = np.arange(len(node)) - first[run]
    gain = gains([left[:, 0], left[:, 1], left[:, 2]], totals[node], p, p.reg_lambda + p.cat_l2)
    gain[place >= p.max_cat_threshold] = NO_SPLIT
    return node, code, left, gain, first[run]


def best_splits(sums: Sums, p: TreeParams, layout: Layout, tree: int, uids: np.ndarray) -> list[Split | None]:
    """The best split of every node, or None. Equal gains go by column, then bin or code."""
    n_nodes, wide, starts = len(sums.totals), len(layout.numbers), layout.starts
    # Candidates: node, column (its number in the layout), hash, drawn, gain, and where to find the split.
    node_of, column_of, hash_of, drawn_of, gain_of, origin = [], [], [], [], [], []
    left_sums: list[np.ndarray] = []
    bin_gain = np.zeros((n_nodes, 0))
    if wide:
        padded = [np.concatenate([np.zeros((n_nodes, 1)), np.cumsum(s, axis=1)], axis=1) for s in sums.numbers]
        of_bin = np.repeat(np.arange(wide), np.diff(starts))
        left_sums = [c[:, 1:] - c[:, starts[of_bin]] for c in padded]
        bin_gain = gains(left_sums, sums.totals[:, None, :], p, p.reg_lambda)
        bin_gain[:, starts[1:] - 1] = NO_SPLIT
        best = np.maximum.reduceat(bin_gain, starts[:-1], axis=1)
        columns = np.tile(np.arange(wide), n_nodes)
        u, drawn = drawn_columns(p, layout, tree, columns, np.repeat(uids, wide))
        node_of.append(np.repeat(np.arange(n_nodes), wide))
        column_of.append(columns)
        hash_of.append(u)
        drawn_of.append(drawn)
        gain_of.append(best.ravel())
        origin.append(np.full(n_nodes * wide, -1))
    tables = []
    for k, (node, code, found) in enumerate(sums.categories):
        column = wide + k
        if p.native_categories:
            made = [category_runs(node, code, found, sums.totals, p, down) for down in (False, True)]
        else:
            gain = gains([found[:, 0], found[:, 1], found[:, 2]], sums.totals[node], p, p.reg_lambda)
            made = [(node, code, found, gain, np.arange(len(node)))]
        for table in made:
            # A category is one column, or one column for each of its codes.
            ids = np.full(len(table[0]), column) if p.native_categories else (column + 1) * (1 << 32) + table[1]
            u, drawn = drawn_columns(p, layout, tree, ids, uids[table[0]])
            node_of.append(table[0])
            column_of.append(np.full(len(table[0]), column))
            hash_of.append(u)
            drawn_of.append(drawn)
            gain_of.append(table[3])
            origin.append(len(tables) * (1 << 32) + np.arange(len(table[0])))
            tables.append(table)
    node, column, u, drawn, gain, from_ = (np.concatenate(a) for a in (node_of, column_of, hash_of, drawn_of, gain_of, origin))
    valid = gain > (NO_SPLIT if p.forest else 1e-10)
    if p.forest:
        # Pure nodes stay; where no drawn column divides a node, the first one that does is taken.
        g, h = sums.totals[:, 0], sums.totals[:, 1]
        valid &= ((g > 0) & (g < h))[node]
    score = np.where(valid & drawn, gain, NO_SPLIT)
    if p.forest:
        has = np.zeros(n_nodes, bool)
        has[node[np.isfinite(score)]] = True
        score = np.where(valid & ~has[node], -u, score)
    order = np.lexsort((from_, column, -score, node))
    order = order[np.isfinite(score[order])]
    out: list[Split | None] = [None] * n_nodes
    if not len(order):
        return out
    for i in order[np.r_[True, node[order][1:] != node[order][:-1]]]:
        s, c = int(node[i]), int(column[i])
        if from_[i] < 0:
            cut = int(np.argmax(bin_gain[s, starts[c] : starts[c + 1]]))
            out[s] = Split(float(gain[i]), c, cut, (), tuple(float(v[s, starts[c] + cut]) for v in left_sums))
        else:
            table = tables[int(from_[i] >> 32)]
            at = int(from_[i] & 0xFFFFFFFF)
            codes = tuple(int(v) for v in table[1][int(table[4][at]) : at + 1])
            out[s] = Split(float(gain[i]), c, -1, codes, tuple(float(v) for v in table[2][at]))
    return out


# ---- growing one tree -------------------------------------------------------------------------------------


@dataclass
class Growing:
    """A tree under construction. Nodes are created in waves; what the growth order never reaches is left out at the end."""

    p: TreeParams
    tree: int
    totals: list[tuple[float, float, float]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    uid: list[int] = field(default_factory=list)
    split: list[Split | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    pending: list[int] = field(default_factory=list)

    @classmethod
    def root(cls, p: TreeParams, tree: int, uid: int = 1, depth: int = 0) -> Growing:
        out = cls(p, tree)
        out._add((0.0, 0.0, 0.0), depth, uid)
        return out

    def _add(self, totals: tuple[float, float, float], depth: int, uid: int) -> int:
        self.totals.append(totals)
        self.depth.append(depth)
        self.uid.append(uid)
        self.split.append(None)
        self.left.append(-1)
        self.pending.append(len(self.left) - 1)
        return len(self.left) - 1

    def uids(self, nodes: list[int]) -> np.ndarray:
        return np.array([self.uid[i] for i in nodes], np.uint64)

    def take(self, nodes: list[int], found: list[Split | None]) -> list[int]:
        """Enter the best splits of ``nodes``, divide what the growth order reaches, and return the nodes divided now."""
        for i, split in zip(nodes, found, strict=True):
            deepest = self.p.max_depth is not None and self.depth[i] >= self.p.max_depth
            self.split[i] = None if deepest else split
        done = set(nodes)
        self.pending = [i for i in self.pending if i not in done]
        divided = [i for i in self.reached() if self.left[i] < 0]
        for i in divided:
            split = self.split[i]
            rest = tuple(a - b for a, b in zip(self.totals[i], split.left, strict=True))
            self.left[i] = len(self.left)
            for side, totals in enumerate((split.left, rest)):
                self._add(totals, self.depth[i] + 1, int(mix(np.int64(np.uint64(self.uid[i]).astype(np.int64)), side)))
        return divided

    def reached(self) -> list[int]:
        """Nodes that are divided: all by level, or the best first up to ``num_leaves`` leaves."""
        if self.p.num_leaves is None:
            return [i for i, s in enumerate(self.split) if s is not None]
        heap = [(-self.split[0].gain, 0)] if self.split[0] is not None else []
        out = []
        while heap and len(out) < self.p.num_leaves - 1:
            _, i = heapq.heappop(heap)
            out.append(i)
            if self.left[i] >= 0:
                for child in (self.left[i], self.left[i] + 1):
                    if self.split[child] is not None:
                        heapq.heappush(heap, (-self.split[child].gain, child))
        return out

    def move(self, x: np.ndarray, node_of: np.ndarray, divided: list[int]) -> np.ndarray:
        """The children that rows in divided nodes go to."""
        if not divided:
            return node_of
        column, cut = np.full(len(self.left), -1), np.zeros(len(self.left), np.int64)
        for i in divided:
            column[i], cut[i] = self.split[i].column, self.split[i].cut
        rows = np.flatnonzero(column[node_of] >= 0)
        at = node_of[rows]
        value = x[rows, column[at]]
        goes = value <= cut[at]
        for i in divided:
            if self.split[i].codes:
                own = at == i
                goes[own] = np.isin(value[own], np.array(self.split[i].codes))
        out = node_of.copy()
        out[rows] = np.array(self.left)[at] + ~goes
        return out

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The deepest created node of every row."""
        node_of, level = np.zeros(len(x), np.int64), [0]
        while level:
            level = [i for i in level if self.left[i] >= 0]
            node_of = self.move(x, node_of, level)
            level = [c for i in level for c in (self.left[i], self.left[i] + 1)]
        return node_of

    def finished(self, rate: float) -> tuple[dict[str, list], np.ndarray]:
        """The final tree as columns, nodes renumbered from the root, and the final leaf of every created node."""
        kept = set(self.reached())
        number, leaf_of, stack = {0: 0}, np.zeros(len(self.left), np.int64), [(0, None)]
        order = []
        while stack:
            i, leaf = stack.pop()
            if leaf is None:
                number.setdefault(i, len(number))
                order.append(i)
                leaf = None if i in kept else i
            leaf_of[i] = -1 if leaf is None else leaf
            if self.left[i] >= 0:
                stack += [(self.left[i] + 1, leaf), (self.left[i], leaf)]
        out: dict[str, list] = {c: [] for c in ("node", "column", "cut", "codes", "left", "right", "value", "cover")}
        for i in order:
            split = self.split[i] if i in kept else None
            g, h, n = (t / UNIT for t in self.totals[i])
            out["node"].append(number[i])
            out["column"].append(-1 if split is None else split.column)
            out["cut"].append(-1 if split is None else split.cut)
            out["codes"].append([] if split is None else list(split.codes))
            out["left"].append(-1 if split is None else number[self.left[i]])
            out["right"].append(-1 if split is None else number[self.left[i] + 1])
            out["value"].append(node_value(self.p, g, h, rate))
            out["cover"].append(h if self.p.forest else n)
        return out, np.where(leaf_of < 0, 0, leaf_of)

    def values(self, rate: float) -> np.ndarray:
        """Value of every created node, as a leaf."""
        return np.array([node_value(self.p, g / UNIT, h / UNIT, rate) for g, h, _ in self.totals])


def node_value(p: TreeParams, g: float, h: float, rate: float) -> float:
    """Share of the positives in a forest's node, or the step of a boosted leaf."""
    if p.forest:
        return g / h if h > 0 else 0.0
    return -rate * g / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0


def grow(x: np.ndarray, stats: np.ndarray, layout: Layout, tree: Growing) -> np.ndarray:
    """Grow ``tree`` on rows in memory; rows without weight only follow. Returns the created node of every row."""
    counted = np.flatnonzero(stats[:, 2] > 0)
    node_of = np.zeros(len(x), np.int64)
    tree.totals[0] = tuple(float(s) for s in stats.sum(axis=0))
    while tree.pending:
        nodes = list(tree.pending)
        slot_of = np.full(len(tree.left), -1)
        slot_of[nodes] = np.arange(len(nodes))
        slots = slot_of[node_of[counted]]
        live = counted[slots >= 0]
        sums = sums_of(x[live], slots[slots >= 0], len(nodes), stats[live], layout)
        divided = tree.take(nodes, best_splits(sums, tree.p, layout, tree.tree, tree.uids(nodes)))
        node_of = tree.move(x, node_of, divided)
    return node_of


# ---- gradients -------------------------------------------------------------------------------------------------


def in_units(*columns: np.ndarray) -> np.ndarray:
    """Sums' terms as whole numbers of units, one column each."""
    return np.stack([np.rint(c * UNIT) for c in columns], axis=1)


def base_margin(zero: float, one: float) -> float:
    """Log odds of the weighted base rate."""
    return float(np.log(one / zero)) if zero > 0 and one > 0 else (0.0 if zero == one else (10.0 if one else -10.0))


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and number of rows of the logistic loss, for ``count`` equal rows each."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return in_units((p - y) * weight, p * (1.0 - p) * weight, np.ones(len(p))) * count[:, None]


def sampled(p: TreeParams, tree: int, key: np.ndarray) -> np.ndarray:
    """Rows that a boosted tree sees."""
    if p.subsample >= 1.0 or p.subsample_freq <= 0:
        return np.ones(len(key), bool)
    return uniform(p.random_state, tree // p.subsample_freq, 77, key) < p.subsample


def drawn(p: TreeParams, tree: int, key: np.ndarray) -> np.ndarray:
    """How often each row is in a forest's bootstrap sample."""
    return poisson_counts(uniform(p.random_state, tree, 99, key))


def subsample_weights(zero: float, one: float) -> tuple[float, float]:
    """Balanced weights within one bootstrap sample."""
    return (zero + one) / (2.0 * max(zero, 1.0)), (zero + one) / (2.0 * max(one, 1.0))


def shares(y: np.ndarray, weights: tuple[float, float], count: np.ndarray) -> np.ndarray:
    """Weight of the positives, weight and number of rows, for ``count`` equal rows each."""
    weight = np.where(y > 0, weights[1], weights[0])
    return in_units(weight * (y > 0), weight, np.ones(len(y))) * count[:, None]


@dataclass
class Cells:
    """Rows in memory, equal ones as one cell: trees can't tell them apart."""

    x: np.ndarray
    y: np.ndarray
    train: np.ndarray
    of_row: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, train: np.ndarray) -> Cells:
        rows, of_row = np.unique(np.column_stack([x, y, train]).astype(np.int32), axis=0, return_inverse=True)
        return cls(np.ascontiguousarray(rows[:, :-2]), rows[:, -2], rows[:, -1] > 0, of_row.ravel())

    def count(self, times: np.ndarray) -> np.ndarray:
        """Training rows per cell, each taken so many times."""
        return np.bincount(self.of_row, times, len(self.y)) * self.train

    def everything(self, key: np.ndarray) -> np.ndarray:
        """Training rows per cell."""
        return self.count(np.ones(len(key)))

    def sampled(self, p: TreeParams, tree: int, key: np.ndarray) -> np.ndarray:
        """Training rows per cell that a boosted tree sees."""
        return self.count(sampled(p, tree, key))

    def drawn(self, p: TreeParams, tree: int, key: np.ndarray) -> np.ndarray:
        """Training rows per cell in a forest tree's bootstrap sample."""
        return self.count(drawn(p, tree, key))


@dataclass
class CountedCells(Cells):
    """Cells whose rows were counted before, with how many of them each tree draws: one column per tree, from ``first`` on."""

    n: np.ndarray
    draws: np.ndarray | None
    first: int

    def everything(self, key: np.ndarray) -> np.ndarray:
        return self.n * self.train

    def sampled(self, p: TreeParams, tree: int, key: np.ndarray) -> np.ndarray:
        return self.everything(key) if self.draws is None else self.draws[:, tree - self.first] * self.train

    drawn = sampled


def boost(cells: Cells, key: np.ndarray, weights: tuple[float, float], layout: Layout, p: TreeParams):
    """Boosted trees on rows in memory: (base margin, trees, final margin of every cell). Cells outside the training only follow."""
    weight = np.where(cells.y > 0, weights[1], weights[0])
    everything = cells.everything(key)
    base = base_margin(*[float(weights[c] * everything[cells.y == c].sum()) for c in (0, 1)])
    margin, trees = np.full(len(cells.y), base), []
    for t in range(p.n_estimators):
        tree = Growing.root(p, t)
        count = everything if p.subsample_freq <= 0 else cells.sampled(p, t, key)
        node_of = grow(cells.x, gradients(margin, cells.y, weight, count), layout, tree)
        made, leaf_of = tree.finished(p.learning_rate)
        margin = margin + tree.values(p.learning_rate)[leaf_of[node_of]]
        trees.append(made)
    return base, trees, margin


def forest_tree(cells: Cells, key: np.ndarray, weights: tuple[float, float], layout: Layout, p: TreeParams, t: int):
    """One tree of a forest on rows in memory: the tree and the created node of every cell."""
    count = cells.drawn(p, t, key)
    if p.class_weight == "balanced_subsample":
        weights = subsample_weights(*[float(count[cells.y == c].sum()) for c in (0, 1)])
    tree = Growing.root(p, t)
    return tree, grow(cells.x, shares(cells.y, weights, count), layout, tree)

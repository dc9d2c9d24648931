"""What each feature adds to a tree model's output: Shapley values, or credits along the decision path.

Shapley values are path-dependent: a feature that is left out sends a row down both sides of a node, in proportion to the training
weight (cover) of the children. On the path to a leaf, each feature has the share ``z`` of the cover that passes its
nodes, and ``o``, 1 where the row passes them. The leaf's value then goes to feature i with
``(o_i - z_i) * sum over subsets S of the others: |S|! (d - |S| - 1)! / d! * prod_S o * prod_rest z``. The sums by subset size are
the coefficients of ``prod (z + o t)``, from which each feature's factor is divided out, for all leaves and rows of a batch
at once. Rows with the same decisions in a tree are computed once.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark import cloudpickle

from cmdprism.operators.trees import TreeModel, Walker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers that one step holds at a time (rows x leaves x path length).
STEP_CELLS = 1 << 22


@dataclass
class TreePaths:
    """One tree: its inner nodes, and for each leaf the features of its path with their shares of the cover."""

    inner: np.ndarray  # node numbers
    leaves: np.ndarray  # node numbers
    value: np.ndarray  # (leaves,)
    feature: np.ndarray  # (leaves, d); -1 pads
    share: np.ndarray  # (leaves, d) z; 1 for pads
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per place on a path: (leaf, slot, signed inner place)


class Attribution:
    """Impacts of a model's features; the base value and all impacts of a row add up to its margin (or a forest's share)."""

    def __init__(self, model: TreeModel, one_hot: bool) -> None:
        self.walker: Walker = model.walker
        self.forest = model.forest
        nodes = model.nodes.sort_values(["tree", "node"], ignore_index=True)
        self.scale = 1.0 / max(model.n_trees, 1) if model.forest else 1.0
        known: dict[tuple[str, str | None], int] = {}
        of_node = np.full(len(nodes), -1)
        for i in np.flatnonzero(self.walker.inner):
            name = nodes["column"].iat[i]
            value = nodes["values"].iat[i][0] if one_hot and self.walker.by_value[i] else None
            of_node[i] = known.setdefault((name, value), len(known))
        #: (column, value) of each feature; the value is None but for one-hot columns.
        self.features = list(known)
        self.of_node = of_node
        self.mean = self.node_means()
        self.base = float(model.base + self.scale * self.mean[self.walker.roots].sum())
        self.trees = [self.paths(root) for root in self.walker.roots]

    def node_means(self) -> np.ndarray:
        """Mean leaf value below every node, weighted by cover; children come after their parents."""
        w = self.walker
        out = w.value.copy()
        for i in np.flatnonzero(w.inner)[::-1]:
            sides = [w.left[i], w.right[i]]
            out[i] = np.average(out[sides], weights=w.cover[sides]) if w.cover[sides].sum() > 0 else out[sides].mean()
        return out

    def paths(self, root: int) -> TreePaths:
        w = self.walker
        inner, leaves, stack = [], [], [(int(root), [])]
        while stack:
            node, path = stack.pop()
            if not w.inner[node]:
                leaves.append((node, path))
                continue
            inner.append(node)
            for child, left in ((w.right[node], False), (w.left[node], True)):
                cover = w.cover[node]
                stack.append((int(child), [*path, (node, left, w.cover[child] / cover if cover > 0 else 0.5)]))
        place = {node: i for i, node in enumerate(inner)}
        merged = []
        for _, path in leaves:
            own: dict[int, int] = {}
            for node, _, _ in path:
                own.setdefault(int(self.of_node[node]), len(own))
            merged.append(own)
        d = max((len(m) for m in merged), default=0)
        feature = np.full((len(leaves), d), -1)
        share = np.ones((len(leaves), d))
        at = []
        for i, ((_, path), own) in enumerate(zip(leaves, merged, strict=True)):
            for f, k in own.items():
                feature[i, k] = f
            for node, left, part in path:
                k = own[int(self.of_node[node])]
                share[i, k] *= part
                at.append((i, k, place[node] + 1 if left else -(place[node] + 1)))
        steps = np.array(at, np.int64).reshape(-1, 3)
        numbers = np.array([n for n, _ in leaves], np.int64)
        return TreePaths(np.array(inner, np.int64), numbers, w.value[numbers], feature, share, [tuple(steps.T)])

    def decisions(self, tree: TreePaths, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows of decisions at the inner nodes (left: True), and which of them each row has."""
        n, m = len(x), len(tree.inner)
        rows = np.repeat(np.arange(n), m)
        found = self.walker.goes_left(np.tile(tree.inner, n), rows, x, codes).reshape(n, m)
        packed = np.packbits(found, axis=1)
        _, first, of_row = np.unique(packed, axis=0, return_index=True, return_inverse=True)
        return found[first], of_row.ravel()

    def shapley_of(self, tree: TreePaths, left: np.ndarray) -> np.ndarray:
        """Impacts (rows, features) for distinct decision rows of one tree."""
        n, (leaves, d) = len(left), tree.feature.shape
        out = np.zeros((n, len(self.features)))
        if not d:
            return out
        # Whether a row passes all nodes of a feature on the path to a leaf.
        passes = np.ones((n, leaves, d), bool)
        leaf, slot, signed = tree.steps[0]
        for i, k, s in zip(leaf, slot, signed, strict=True):
            passes[:, i, k] &= left[:, s - 1] if s > 0 else ~left[:, -s - 1]
        o, z = passes.astype(np.float64), tree.share
        poly = np.zeros((d + 1, n, leaves))
        poly[0] = 1.0
        for k in range(d):
            step = poly * z[:, k]
            step[1:] += poly[:-1] * o[:, :, k]
            poly = step
        weights = [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]
        for k in range(d):
            # Factor z + o t divided out: from the top where o is 1 (z is at most 1, so nothing grows), by z where it is 0.
            through, blocked = np.zeros((n, leaves)), np.zeros((n, leaves))
            quotient = poly[d]
            for s in range(d - 1, -1, -1):
                through += weights[s] * quotient
                blocked += weights[s] * poly[s]
                quotient = poly[s] - z[:, k] * quotient
            total = np.where(passes[:, :, k], through, blocked / np.where(z[:, k] > 0, z[:, k], 1.0))
            impact = (o[:, :, k] - z[:, k]) * total * tree.value
            for f in np.unique(tree.feature[:, k]):
                if f >= 0:
                    out[:, f] += impact[:, tree.feature[:, k] == f].sum(axis=1)
        return out

    def shapley(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.features)))
        for tree in self.trees:
            if not len(tree.inner):
                continue
            left, of_row = self.decisions(tree, x, codes)
            step = max(1, STEP_CELLS // max(1, tree.feature.size))
            made = np.concatenate([self.shapley_of(tree, left[i : i + step]) for i in range(0, len(left), step)])
            out += made[of_row]
        return out * self.scale

    def path_credits(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The change of the mean leaf value at every step of a row's path goes to the feature split on."""
        w = self.walker
        out = np.zeros((len(x), len(self.features)))
        for root in w.roots:
            node, live = np.full(len(x), root), np.arange(len(x))
            while True:
                live = live[w.inner[node[live]]]
                if not len(live):
                    break
                at = node[live]
                node[live] = np.where(w.goes_left(at, live, x, codes), w.left[at], w.right[at])
                out[live, self.of_node[at]] += self.mean[node[live]] - self.mean[at]
        return out * self.scale

    def impacts(self, method: str, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Impacts (rows, features) by ``method``; equal rows are computed once."""
        if not len(x):
            return np.zeros((0, len(self.features)))
        _, first, of_row = np.unique(np.column_stack([x, codes.astype(np.float64)]), axis=0, return_index=True, return_inverse=True)
        made = {"shapley": self.shapley, "path": self.path_credits}[method](x[first], codes[first])
        return made[of_row.ravel()]

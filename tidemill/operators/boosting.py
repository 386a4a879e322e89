"""Boosted trees on binned features, from sums of gradients and hessians.

Features are binned once. For each step of growth a task adds up gradients and hessians of its rows by class, node,
feature and bin; tasks' sums are merged by blocks of features, and each block's best split of every node is all that the
driver sees. The trees of all classes grow together, so a step is one pass whatever the number of classes. Missing values have
a bin of their own, and each split tries them on both sides.

Two ways to grow: ``depth`` splits all nodes of a level; ``leaf`` splits, in each tree, the leaf with the largest gain.
(Chen and Guestrin 2016, arXiv:1603.02754; Ke et al., LightGBM, 2017.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ridge import as_array
from tidemill.session import materialize

HISTOGRAM_BYTES = 64 << 20  # of a pass in one task; wider data take a pass for each block of features
_SPLIT = ("gain", "feature", "bin", "missing_left", "left_g", "left_h", "right_g", "right_h")


class Tree:
    """Arrays of nodes; a leaf has no feature. A row goes left if its bin is at most ``bin``."""

    def __init__(self, value: float):
        self.feature, self.bin, self.missing_left, self.left, self.right, self.value = [-1], [0], [True], [0], [0], [value]

    def split(self, node: int, feature: int, bin_: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = at, at + 1
        for value in values:
            for name, x in zip(("feature", "bin", "missing_left", "left", "right", "value"), (-1, 0, True, 0, 0, value)):
                getattr(self, name).append(x)
        return at, at + 1

    def leaves(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of every row."""
        feature, limit, side, left, right = (np.array(getattr(self, n)) for n in ("feature", "bin", "missing_left", "left", "right"))
        node = np.zeros(len(bins), dtype=np.int64)
        while (inner := feature[node] >= 0).any():
            at = np.flatnonzero(inner)
            n = node[at]
            x = bins[at, feature[n]]
            goes = np.where(x == missing, side[n], x <= limit[n])
            node[at] = np.where(goes, left[n], right[n])
        return node


class Best(NamedTuple):
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left_g: float
    left_h: float
    right_g: float
    right_h: float


def _gradients(loss: str, margins: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin."""
    if loss == "squared":
        return margins - target[:, None], np.ones_like(margins)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (np.arange(margins.shape[1]) == target[:, None]), np.maximum(p * (1 - p), 1e-16)


def _best_splits(sums: np.ndarray, first: int, l2: float, min_hessian: float, min_rows: int) -> np.ndarray:
    """For each (tree, node), the best split among these features, a row of ``_SPLIT``; gain -inf where none is allowed.

    ``sums``: (gradient, hessian, rows) by tree, node, feature and bin; the last bin holds missing values. Of equal gains
    the first feature, bin and then missing values to the left.
    """
    total = sums.sum(axis=4, keepdims=True)
    whole = np.cumsum(sums[..., :-1], axis=4)[..., :-1]  # left sides of all cuts between bins of values
    lost = sums[..., -1:]
    left = np.stack([whole + lost, whole], axis=-1)  # missing values to the left, to the right
    right = total[..., None] - left
    score = lambda s: s[0] ** 2 / np.maximum(s[1] + l2, 1e-16)
    gain = 0.5 * (score(left) + score(right) - score(total[..., None]))
    allowed = (np.minimum(left[2], right[2]) >= max(1, min_rows)) & (np.minimum(left[1], right[1]) >= min_hessian)
    gain = np.where(allowed, gain, -np.inf)
    trees, nodes, features, cuts, _ = gain.shape
    flat = gain.reshape(trees * nodes, -1)
    if not flat.shape[1]:
        return np.full((trees * nodes, len(_SPLIT)), -np.inf)
    at = flat.argmax(axis=1)
    f, c, side = np.unravel_index(at, (features, cuts, 2))
    pick = lambda s: s.reshape(trees * nodes, -1)[np.arange(trees * nodes), at]
    return np.column_stack([flat[np.arange(len(at)), at], f + first, c, side == 0, pick(left[0]), pick(left[1]), pick(right[0]), pick(right[1])])


class BoostingModel:
    def __init__(self, features: str, loss: str, base: np.ndarray, cuts: list[np.ndarray], trees: list[list[Tree]], classes: Sequence | None):
        self.features, self.loss, self.base, self.cuts, self.trees, self.classes = features, loss, base, cuts, trees, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``scores`` (class probabilities, or the one value) and ``prediction``."""
        model = self

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = to_bins(np.array([[np.nan if v is None else v for v in row] for row in x], dtype=float), model.cuts)
            margins = np.repeat(model.base[None], len(x), axis=0)
            for grown in model.trees:
                _add(margins, grown, bins, _missing(model.cuts))
            if model.loss == "softmax":
                margins = np.exp(margins - margins.max(axis=1, keepdims=True))
                margins /= margins.sum(axis=1, keepdims=True)
            return pd.Series(list(margins))

        scored = df.withColumn("scores", score(as_array(df, self.features)))
        if self.classes is None:
            return scored.withColumn("prediction", F.get("scores", F.lit(0)))
        best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
        return scored.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes]), best).cast("double"))


def _missing(cuts: list[np.ndarray]) -> int:
    """Number of the bin of missing values, after the bins of every feature."""
    return max((len(c) for c in cuts), default=0) + 1


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many cuts lie below it; a value on a cut is in the cut's bin."""
    out = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)
    out[np.isnan(x)] = _missing(cuts)
    return out


def _add(margins: np.ndarray, grown: list[Tree], bins: np.ndarray, missing: int) -> None:
    for k, tree in enumerate(grown):
        margins[:, k] += np.array(tree.value)[tree.leaves(bins, missing)]


class Boosting:
    """Gradient boosting with second derivatives: softmax over all classes, or squared error (``loss="squared"``).

    A split's gain is (GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)) / 2 - ``gamma`` and must be positive; a leaf is -``rate`` G/(H+l2).
    Cuts are at most ``bins`` - 1 quantiles of a feature, or its values where there are no more. The first margins are the
    classes' log shares, or the mean. Rows with a null target are left out; null and NaN features are missing values.
    """

    def __init__(self, features: str = "features", label: str = "label", rounds: int = 10, growth: str = "depth", rate: float = 0.3, l2: float = 1.0,
                 gamma: float = 0.0, min_hessian: float = 1e-3, min_rows: int = 1, max_depth: int = 6, max_leaves: int = 31, bins: int = 255,
                 loss: str = "softmax", weight: str | None = None):
        if growth not in ("depth", "leaf") or loss not in ("softmax", "squared"):
            raise ValueError("growth is 'depth' or 'leaf', loss 'softmax' or 'squared'")
        self.features, self.label, self.rounds, self.growth, self.rate, self.l2, self.gamma = features, label, rounds, growth, rate, l2, gamma
        self.min_hessian, self.min_rows, self.max_depth, self.max_leaves, self.bins = min_hessian, min_rows, max_depth, max_leaves, bins
        self.loss, self.weight = loss, weight

    def _cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Cuts of each feature, at most ``bins`` - 1 numbers each: a bounded summary of all rows."""
        each = rows.select(F.posexplode("x").alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        shares = [(k + 1) / self.bins for k in range(self.bins - 1)]
        found = each.groupBy("i").agg(F.percentile_approx("v", shares, 100 * self.bins).alias("cuts"), F.max("v").alias("top"),
                                      F.approx_count_distinct("v").alias("values")).collect()
        few = [r.i for r in found if r["values"] <= 1.2 * self.bins]
        values: dict[int, list[float]] = {}
        for r in each.where(F.col("i").isin(few)).distinct().collect() if few else []:  # some hundred values of a feature
            values.setdefault(r.i, []).append(r.v)
        out = [np.zeros(0)] * width
        for r in found:
            own = values.get(r.i, [])
            cuts = np.unique(own if 0 < len(own) <= self.bins else r.cuts)
            out[r.i] = cuts[cuts < r.top]
        return out

    def fit(self, df: DataFrame) -> BoostingModel:
        known = df.filter(F.col(self.label).isNotNull())
        classes = sorted(r[0] for r in known.select(self.label).distinct().collect()) if self.loss == "softmax" else None
        if classes is not None and len(classes) < 2:
            raise ValueError("a classifier needs two classes at least")
        label = F.col(self.label)
        target = F.array_position(F.array(*[F.lit(c) for c in classes]), label).cast("double") - 1 if classes else label.cast("double")
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        raw = known.select(as_array(df, self.features).alias("x"), target.alias("y"), weight.alias("w"))
        first = raw.first()
        if first is None:
            raise ValueError("no rows to fit")
        cuts = self._cuts(raw, len(first.x))
        if classes:
            share = {r.y: r.w for r in raw.groupBy("y").agg(F.sum("w").alias("w")).collect()}
            base = np.log(np.array([share[float(k)] for k in range(len(classes))]) / sum(share.values()))
        else:
            base = np.array([raw.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]])
        state = self._advance(raw, cuts, base, None)
        trees = []
        for _ in range(self.rounds):
            grown = self._grow(state, len(base), cuts)
            if all(len(t.feature) == 1 for t in grown):
                break
            trees.append(grown)
            state = self._advance(state, cuts, base, grown)
        return BoostingModel(self.features, self.loss, base, cuts, trees, classes)

    def _advance(self, rows: DataFrame, cuts: list[np.ndarray], base: np.ndarray, grown: list[Tree] | None) -> DataFrame:
        """Written rows with bins and margins: at first from the values, later the margins moved by the grown trees."""
        missing = _missing(cuts)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if grown is None:
                    bins, margins = to_bins(x.astype(float), cuts), np.repeat(base[None], n, axis=0)
                else:
                    bins, margins = x.astype(np.int64), batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()
                    _add(margins, grown, bins, missing)
                def lists(m, kind):
                    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(m.ravel(), kind))

                yield pa.RecordBatch.from_arrays([lists(bins, pa.int16()), batch.column(1), batch.column(2), lists(margins, pa.float64())], names=["x", "y", "w", "m"])

        return materialize(rows.mapInArrow(step, "x array<short>, y double, w double, m array<double>"), "boosted")

    def _sums(self, state: DataFrame, grown: list[Tree], open_nodes: list[list[int]], cuts: list[np.ndarray]) -> list[list[Best | None]]:
        """The best split of each open node of each tree, by one pass for each block of features."""
        width, bins, missing = len(cuts), _missing(cuts) + 1, _missing(cuts)
        most = max(len(n) for n in open_nodes)
        loss, l2, min_hessian, min_rows = self.loss, self.l2, self.min_hessian, self.min_rows
        one = 3 * 8 * len(grown) * most * bins
        block = max(1, HISTOGRAM_BYTES // one)
        panel = max(1, min(block, (4 << 20) // one))  # features whose sums are merged in one place
        best: list[list[Best | None]] = [[None] * most for _ in grown]
        for low in range(0, width, block):
            high = min(width, low + block)

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((3, len(grown), most, high - low, bins))
                flat = total.reshape(3, -1)
                for batch in batches:
                    n = batch.num_rows
                    if not n:
                        continue
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
                    margins = batch.column("m").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    w = batch.column("w").to_numpy(zero_copy_only=False)
                    g, h = _gradients(loss, margins, batch.column("y").to_numpy(zero_copy_only=False))
                    for k, tree in enumerate(grown):
                        place = np.full(len(tree.feature), -1)
                        place[open_nodes[k]] = np.arange(len(open_nodes[k]))
                        node = place[tree.leaves(x, missing)]
                        at = np.flatnonzero(node >= 0)
                        cell = (((k * most + node[at])[:, None] * (high - low) + np.arange(high - low)) * bins + x[at, low:high]).ravel()
                        for s, v in enumerate((g[at, k] * w[at], h[at, k] * w[at], np.ones(len(at)))):
                            flat[s] += np.bincount(cell, np.repeat(v, high - low), flat.shape[1])
                parts = [total[:, :, :, a:a + panel].tobytes() for a in range(0, high - low, panel)]
                yield pa.RecordBatch.from_arrays([pa.array(range(low, high, panel), pa.int32()), pa.array(parts, pa.binary())], names=["first", "data"])

            def merge(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
                sums = sum(np.frombuffer(p, float) for p in parts.column("data").to_pylist())
                sums = sums.reshape(3, len(grown), most, -1, bins)
                found = _best_splits(sums, key[0].as_py(), l2, min_hessian, min_rows)
                return pa.table({"first": [key[0].as_py()], "data": [found.tobytes()]}, schema=pa.schema([("first", pa.int32()), ("data", pa.binary())]))

            shape = "first int, data binary"
            for r in state.mapInArrow(add, shape).groupBy("first").applyInArrow(merge, shape).orderBy("first").collect():
                for i, row in enumerate(np.frombuffer(r.data, float).reshape(-1, len(_SPLIT))):
                    k, n = divmod(i, most)
                    if n < len(open_nodes[k]) and np.isfinite(row[0]) and (best[k][n] is None or row[0] > best[k][n].gain):
                        best[k][n] = Best(row[0], int(row[1]), int(row[2]), bool(row[3]), *row[4:])
        return best

    def _grow(self, state: DataFrame, n_trees: int, cuts: list[np.ndarray]) -> list[Tree]:
        """One tree for each margin."""
        grown = [Tree(0.0) for _ in range(n_trees)]
        fresh = [[0] for _ in grown]
        depth: list[dict[int, int]] = [{0: 0} for _ in grown]
        waiting: list[dict[int, Best]] = [{} for _ in grown]  # leaves with a split that is worth it
        while cuts and any(fresh):
            found = self._sums(state, grown, fresh, cuts)
            for k, nodes in enumerate(fresh):
                for node, split in zip(nodes, found[k]):
                    if split and split.gain > self.gamma + 1e-12:
                        waiting[k][node] = split
            fresh = [[] for _ in grown]
            for k, tree in enumerate(grown):
                if self.growth == "leaf":
                    room = len(tree.feature) // 2 + 1 < self.max_leaves
                    chosen = [max(waiting[k], key=lambda n: (waiting[k][n].gain, -n))] if waiting[k] and room else []
                else:
                    chosen = list(waiting[k])
                for node in chosen:
                    s = waiting[k].pop(node)
                    values = tuple(-self.rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0 for g, h in ((s.left_g, s.left_h), (s.right_g, s.right_h)))
                    for child in tree.split(node, s.feature, s.bin, s.missing_left, values):
                        depth[k][child] = depth[k][node] + 1
                        if self.growth == "leaf" or depth[k][child] < self.max_depth:
                            fresh[k].append(child)
        return grown

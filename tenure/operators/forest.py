"""Class-weighted random forests (two classes) grown where their rows are.

MLlib sums a full histogram (features x bins) for every node in every task, also for a node of a
handful of rows; trees without a depth limit have as many such nodes as rows, so memory, shuffle and
time were those of the histograms.  Here, as in PLANET, only nodes of more than ``SUBTREE_ROWS`` rows
are split from histograms summed by Spark, one job a level.  A smaller node's rows are dealt to
one group, whose task grows the rest of the tree and scores the rows that were dealt to it.  Inside a task
a node of many rows is split from histograms, one of few by sorting; forests that differ in their least
leaf only share every node that the leaf size leaves alike.

The rules are MLlib's: split candidates from (weighted) counts of values in a sample of ``max_bins``
squared rows, Poisson(1) bootstrap, a random feature subset a node, Gini gain, least bagged rows a
child, and equal leaves below one parent merged.  A row's bootstrap counts are a hash of its number and
the tree, so neither retries nor the number of tasks change the forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.session import stage_shared

SUBTREE_ROWS = 500_000       # bagged rows of a node that one task may finish
TREES_A_GROUP = 3            # trees grown from one dealt copy of a row
LEVEL_NODES = 256            # nodes sorted together: (node, bin) fits 16 bits
LEVEL_ROWS = 20_000          # rows sorted or summed together, but for a single larger node
SUMMED_ROWS = 128            # rows from which a node is split by histograms, not by sorting
SUMMED_NODES = 32            # nodes whose histograms are held together
SHARED_TRIED = 8             # shared bytes tried for a column of two bins
WALKED_ROWS = 200            # rows of a node that walk down by themselves
LEAST_GAIN = 1e-12           # below: rounding
PURE = 1e-12
LIVE_SUMS = 200              # histograms held before a task hands them on
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_NODE = ("tree int, node int, left int, right int, feature int, threshold double, gain double, "
         "weight double, impurity double, w0 double, w1 double")
_SLIM = "_id long, label double, weight double, _train boolean, _score boolean, bins binary"
_OUT = _NODE + ", top int, _id long, vote double"
_BLOCK = "block long, ids binary, label binary, weight binary, train binary, score binary, bins binary"
_WHOLE = _NODE + ", _min_leaf int, block long, ids binary, votes binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", ")])


_SCHEMA = _arrow_schema(_OUT)


@dataclass
class Forest:
    nodes: DataFrame             # see ``models.forest_nodes``
    scored: DataFrame            # the scored rows with ``probability`` of class 1 and ``prediction``
    n_features: int

    @property
    def featureImportances(self) -> DenseVector:
        """One share a feature, summing to 1: impurity decrease times weight, by tree, then over the trees."""
        gains = self.nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
        totals = gains.groupBy("tree").agg(F.sum("g").alias("t")).where("t > 0")
        out = np.zeros(self.n_features)
        for r in gains.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("s")).collect():
            out[r["feature"]] = r["s"]                         # as many rows as the design has columns
        return DenseVector(out / out.sum() if out.sum() > 0 else out)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bag_counts(ids: np.ndarray, tree: int, seed: int, n_trees: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1); a single tree takes every row once."""
    if n_trees == 1:
        return np.ones(len(ids), np.int64)
    start = np.uint64(((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) % 2**64)
    u = (_mix(_mix(ids.astype(np.uint64)) + start) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_CDF, u, side="right")


def feature_splits(train: DataFrame, n_rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """MLlib's split candidates of every feature: midpoints of neighbouring values, or of about equally
    many (weighted) rows where there are more values than bins.  From a sample of ``max_bins`` squared rows."""
    need, n_splits = max(max_bins * max_bins, 10_000), min(max_bins, n_rows) - 1
    sample = train.sample(False, need / n_rows, seed) if need < n_rows else train

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy()
        mid = (x[:-1] + x[1:]) / 2
        if len(mid) > n_splits:
            stride, seen, kept = n.sum() / (n_splits + 1), np.cumsum(n), []
            target = stride
            for i in range(1, len(x)):
                if abs(seen[i - 1] - target) < abs(seen[i] - target):
                    kept.append(i - 1)
                    target += stride
            mid = mid[kept]
        return pd.DataFrame({"feature": int(pdf["feature"].iloc[0]), "splits": [mid.tolist()]})

    counts = (sample.select("weight", F.posexplode(vector_to_array("features")).alias("feature", "x"))
                    .groupBy("feature", "x").agg(F.sum("weight").alias("n")))
    found = counts.groupBy("feature").applyInPandas(candidates, "feature int, splits array<double>").collect()
    return [np.array(r["splits"]) for r in sorted(found, key=lambda r: r["feature"])]    # features x bins


def _binned(rows: DataFrame, splits: list[np.ndarray]) -> DataFrame:
    """A byte a feature: how many of its split candidates lie below the value."""
    def bins(frames):
        for pdf in frames:
            x = np.stack(pdf.pop("features").to_numpy()) if len(pdf) else np.zeros((0, len(splits)))
            b = np.stack([np.searchsorted(s, x[:, i], side="left") for i, s in enumerate(splits)], axis=1).astype(np.uint8)
            yield pdf.assign(bins=[r.tobytes() for r in b])

    return (rows.select("_id", "label", "weight", "_train", "_score", vector_to_array("features").alias("features"))
                .mapInPandas(bins, _SLIM))


def _blocks(rows: DataFrame, splits: list[np.ndarray]) -> DataFrame:
    """As ``_binned``, a batch of rows a record: arrays of the rows' numbers, labels, weights and flags, and their
    bins column by column.  A forest deals every row to many tasks; a record a row would cost more than its tree."""
    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, len(splits))
            bins = np.stack([np.searchsorted(s, x[:, i], side="left").astype(np.uint8) for i, s in enumerate(splits)])
            ids, label, weight, train, score = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "label", "weight", "_train", "_score"))
            yield pa.RecordBatch.from_pylist([{
                "block": int(ids[0]), "ids": ids.astype(np.int64).tobytes(), "label": label.astype(float).tobytes(),
                "weight": weight.astype(float).tobytes(), "train": train.astype(bool).tobytes(), "score": score.astype(bool).tobytes(),
                "bins": bins.tobytes()}], _arrow_schema(_BLOCK))

    return (rows.select("_id", "label", "weight", "_train", "_score", vector_to_array("features").alias("features"))
                .mapInArrow(pack, _BLOCK))


def _unpacked(table: pa.Table, n: int):
    """The rows of all blocks, in the order of the blocks' numbers: numbers, bins, labels, weights, flags, and each
    block's number and end."""
    number = table["block"].to_numpy()
    order = np.argsort(number)
    each = lambda c, t: (np.frombuffer(table[c][int(i)].as_buffer(), t) for i in order)
    ids = list(each("ids", np.int64))
    ends, ids = np.cumsum([len(i) for i in ids]), np.concatenate(ids)
    joined = (np.concatenate(list(each(c, t))) for c, t in (("label", float), ("weight", float), ("train", bool), ("score", bool)))
    return (ids, _Parts([b.reshape(n, -1) for b in each("bins", np.uint8)]), *joined, list(zip(number[order].tolist(), ends)))


def _subset(seed: int, tree: int, nodes: np.ndarray, n: int, m: int) -> np.ndarray:
    """``m`` of ``n`` features a node, drawn by the tree's and the node's numbers: smallest hashes win."""
    if m >= n:
        return np.tile(np.arange(n), (len(nodes), 1))
    start = np.uint64(((seed * 7_919 + tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    h = _mix(_mix(nodes.astype(np.uint64) + start)[:, None] + np.arange(1, n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(h, m - 1, axis=1)[:, :m], axis=1)


def _gains(l0, l1, t0, t1):
    """Gini impurity of the whole less that of both sides."""
    r0, r1 = t0 - l0, t1 - l1
    left, right, total = l0 + l1, r0 + r1, t0 + t1
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = (l0 * l0 + l1 * l1) / left + (r0 * r0 + r1 * r1) / right
        gain = (inside - (t0 * t0 + t1 * t1) / total) / total
    return np.where((left > 0) & (right > 0), gain, -1.0)


def _gini(w0, w1):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w0 + w1 > 0, 1 - (w0 * w0 + w1 * w1) / (w0 + w1) ** 2, 0.0)


def _first_best(node: np.ndarray, gain: np.ndarray, n: int, place: np.ndarray) -> np.ndarray:
    """The position of each node's largest gain (of equals that of least ``place``), -1 without one above rounding."""
    best = np.full(n, LEAST_GAIN)
    np.maximum.at(best, node, gain)
    at = np.flatnonzero(gain == best[node])
    at = at[np.argsort(-place[at], kind="stable")]
    out = np.full(n, -1)
    out[node[at]] = at
    return out


class _Parts:
    """Bins of rows that lie in several arrays (features x rows), read a column at a time."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.shape = parts, (sum(p.shape[1] for p in parts), len(parts[0]))

    def column(self, f: int) -> np.ndarray:
        return np.concatenate([p[f] for p in self.parts])


class _Columns:
    """The bins of rows, a column of bytes each.  Columns of two bins of which no row has two ones share a byte, the
    number of the one, so that the levels of a one-hot variable are summed together."""

    def __init__(self, bins):
        column = bins.column if isinstance(bins, _Parts) else lambda f: bins[:, f]
        two = np.array([column(f).max(initial=0) <= 1 for f in range(bins.shape[1])], bool)
        self.two, self.many, self.shape = np.flatnonzero(two), np.flatnonzero(~two), bins.shape
        shared, used, self.byte, self.code = [], [], np.zeros(len(self.two), np.int64), np.zeros(len(self.two), np.int64)
        for i, f in enumerate(self.two):
            ones = np.flatnonzero(column(f).astype(bool))
            for k in range(len(shared) - 1, max(-1, len(shared) - 1 - SHARED_TRIED), -1):
                if used[k] < 255 and not shared[k][ones[:256]].any() and not shared[k][ones].any():
                    break
            else:
                k = len(shared)
                shared.append(np.zeros(bins.shape[0], np.uint8))
                used.append(0)
            used[k] += 1
            shared[k][ones] = used[k]
            self.byte[i], self.code[i] = k, used[k]
        self.shared, self.empty = len(shared), len(self.many) + len(shared)
        self.values = np.zeros((self.empty + 1, bins.shape[0]), np.uint8)              # the last one is empty
        for i, f in enumerate(self.many):
            self.values[i] = column(f)
        for k in range(len(shared)):
            self.values[len(self.many) + k] = shared[k]
        self.one = np.full((len(shared), 256), len(self.two))                          # (byte, number): position in ``two``
        self.one[self.byte, self.code] = np.arange(len(self.two))
        # A row goes right if its byte lies above ``low`` (a column of many bins: above the cut) and not above ``high``.
        self.row, self.low, self.high = (np.zeros(bins.shape[1], np.int64) for _ in range(3))
        self.row[self.many], self.high[self.many] = np.arange(len(self.many)), 255
        self.row[self.two], self.low[self.two], self.high[self.two] = len(self.many) + self.byte, self.code - 1, self.code

    def right_of(self, rows, feature, cut):
        """Which of ``rows`` lie above the cuts of their features."""
        at = self.row[feature]
        x = self.values[at].take(rows) if np.ndim(at) == 0 else self.values.ravel().take(at * self.shape[0] + rows)
        return (x > self.low[feature] + cut) & (x <= self.high[feature])


@dataclass
class _Bag:
    """What a tree weighs its rows with: ``sums`` has each row's count, weight of class 0 and of class 1, all to be
    multiplied by ``scale``; ``unit`` is the weight of its own class, ``side`` 256 for class 1.  Where a class has one
    weight, units are counts (``counts``)."""
    sums: np.ndarray
    unit: np.ndarray
    side: np.ndarray
    scale: np.ndarray
    counts: bool
    positive: bool

    @staticmethod
    def of(count, label, weight):
        one = label > 0
        same = [np.unique(weight[(one == k) & (count > 0)][[0, -1]]) if ((one == k) & (count > 0)).any() else np.ones(1) for k in (False, True)]
        counts = all(len(s) == 1 and (weight[(one == k) & (count > 0)] == s[0]).all() for k, s in zip((False, True), same))
        unit = count.astype(float) if counts else count * weight
        scale = np.array([1.0, same[0][0], same[1][0]]) if counts else np.ones(3)
        sums = np.stack([count.astype(float), unit * ~one, unit * one])
        return _Bag(sums, unit, one * 256, scale, counts, bool((weight[count > 0] > 0).all()))


def _drawn(cols: _Columns, subset):
    """Of the features drawn by each node: which columns of two bins, and the rows of ``values`` of the others,
    a node's own first, then the empty one."""
    drawn = np.zeros((len(subset), cols.shape[1]), bool)
    np.put_along_axis(drawn, subset, True, axis=1)
    many = drawn[:, cols.many]
    width = int(many.sum(axis=1).max(initial=0))
    slots = np.argsort(~many, axis=1, kind="stable")[:, :width]
    slots[~np.take_along_axis(many, slots, axis=1)] = cols.empty
    return drawn[:, cols.two], slots


def _totals(w, rows, sizes):
    """The sums of ``w`` (columns as rows) over each node's rows, a node a row."""
    return np.stack([np.add.reduceat(c[rows], np.cumsum(sizes) - sizes) for c in w], axis=1)


def _sorted_candidates(cols: _Columns, rows, sizes, w, subset, total):
    """Every place where a node may be split: (node, feature, bin, sums to the left).  ``rows`` lie node by node,
    ``sizes`` and ``total`` are theirs.  One stable sort a slot of the drawn columns by (node, bin) puts a node's
    values in order; columns of two bins are summed over their ones."""
    n, node, sums = len(sizes), np.repeat(np.arange(len(sizes)), sizes), [c[rows] for c in w]
    two, slots = _drawn(cols, subset)
    ones, wide = np.zeros((3, n, len(cols.two) + 1)), len(cols.two) + 1
    for k in range(cols.shared):
        cell = cols.one[k].take(cols.values[len(cols.many) + k].take(rows)) + node * wide
        for i in range(3):
            ones[i] += np.bincount(cell, sums[i], n * wide).reshape(n, wide)
    two &= (ones[0, :, :-1] > 0) & (ones[0, :, :-1] < total[:, :1])
    here, slot = np.nonzero(two)
    left = [[total[here, i] - ones[i, here, slot]] for i in range(3)]
    found, feature, cut = [here], [cols.two[slot]], [np.zeros(len(here), np.int64)]

    if slots.shape[1]:
        key = cols.values.ravel().take((slots * cols.shape[0]).T[:, node] + rows) + (node * 256).astype(np.uint16)
        order = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, axis=1)
        slot, at = np.nonzero((key[:, 1:] != key[:, :-1]) & (node[1:] == node[:-1]))   # a value ends here, not its node
        here, before = node[at], np.cumsum(total, axis=0) - total
        for i in range(3):
            left[i].append(np.cumsum(sums[i][order], axis=1)[slot, at] - before[here, i])
        found.append(here)
        feature.append(cols.many[slots[here, slot]])
        cut.append((key[slot, at] & 255).astype(np.int64))
    return np.concatenate(found), np.concatenate(feature), np.concatenate(cut), [np.concatenate(x) for x in left]


def _summed_candidates(cols: _Columns, rows, sizes, bag: _Bag, subset, total, least):
    """As ``_sorted_candidates``, for nodes of many rows: a histogram of both classes a drawn column and shared byte.
    Counts are only summed where units are none and a leaf must have more than one row."""
    n, node = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    two, slots = _drawn(cols, subset)
    width = slots.shape[1]
    counted = not bag.counts and (least > 1 or not bag.positive)
    sums, rows_of = np.empty((2, width + cols.shared, n, 256)), np.empty((width + cols.shared, n, 256))
    unit, count = bag.unit[rows], None if bag.counts else bag.sums[0][rows]
    cell = bag.side[rows] + node * 512 if n > 1 else bag.side[rows]
    for s in range(width + cols.shared):
        if s >= width or n == 1:
            at = cols.values[len(cols.many) + s - width if s >= width else slots[0, s]].take(rows) + cell
        else:
            at = cols.values.ravel().take((slots[:, s] * cols.shape[0])[node] + rows) + cell
        h = np.bincount(at, unit, n * 512).reshape(n, 2, 256)
        sums[0, s], sums[1, s] = h[:, 0], h[:, 1]
        if counted or (s >= width and not bag.counts):
            h = np.bincount(at, count, n * 512).reshape(n, 2, 256)
        rows_of[s] = h[:, 0] + h[:, 1]

    ones = [a[width:][cols.byte, :, cols.code].T for a in (rows_of, sums[0], sums[1])]   # node x column of two bins
    two &= (ones[0] > 0) & (ones[0] < total[:, :1])
    here, slot = np.nonzero(two)
    left = [[total[here, i] - ones[i][here, slot]] for i in range(3)]
    found, feature, cut = [here], [cols.two[slot]], [np.zeros(len(here), np.int64)]

    at = np.flatnonzero(rows_of[:width] > 0)
    at = at[:-1][at[1:] >> 8 == at[:-1] >> 8]                                          # a value ends here, not its node
    slot, here = np.divmod(at >> 8, n)
    for i, a in enumerate((rows_of, sums[0], sums[1])):
        left[i].append(np.cumsum(a[:width], axis=2).ravel()[at] if i or counted or bag.counts else np.full(len(at), np.inf))
    found.append(here)
    feature.append(cols.many[slots[here, slot]] if width else slot)
    cut.append(at & 255)
    return np.concatenate(found), np.concatenate(feature), np.concatenate(cut), [np.concatenate(x) for x in left]


def _choose(total, here, feature, cut, left, scale, min_leafs):
    """Best (feature, bin, gain) of each node for each of ``min_leafs``: arrays of leaf sizes x nodes; feature -1 without a split."""
    n, out = len(total), [np.full((len(min_leafs), len(total)), -1), np.zeros((len(min_leafs), len(total)), np.int64), np.zeros((len(min_leafs), len(total)))]
    if not len(here):
        return out
    gain = _gains(left[1] * scale[1], left[2] * scale[2], total[here, 1] * scale[1], total[here, 2] * scale[2])
    smaller = np.minimum(left[0], total[here, 0] - left[0]) if np.isfinite(left[0]).all() else None    # no counts: no side is empty
    for i, leaf in enumerate(min_leafs):
        fits = gain if smaller is None else np.where(smaller < leaf, -1.0, gain)
        best = _first_best(here, fits, n, feature * 256 + cut)
        for a, x in zip(out, (feature, cut, fits)):
            a[i] = np.where(best >= 0, x[best], a[i])
    return out


def _split_level(cols: _Columns, rows, sizes, w, subset, min_leaf):
    """Best (feature, bin, gain) of each node of a chunk, ``rows`` sorted by value."""
    total = _totals(w.T, rows, sizes)
    return [a[0] for a in _choose(total, *_sorted_candidates(cols, rows, sizes, w.T, subset, total), np.ones(3), [min_leaf])]


def grow_subtrees(cols: _Columns, rows, bag: _Bag, tree, root, seed, n_sub, min_leafs, max_depth):
    """A tree below ``root`` over the bagged ``rows`` for each of ``min_leafs``: nodes by level as arrays (number, left and
    right position or -1, feature, bin, gain, w0, w1), equal leaves merged.

    The trees have the same rows and draw the same features, so they differ only below nodes where a leaf size
    forbids a split: a node is split once for all trees that still share it (``alive``: leaf sizes x nodes)."""
    keys, least = ("node", "left", "right", "feature", "cut", "gain", "w0", "w1"), min(min_leafs)
    out = [{k: [] for k in keys} for _ in min_leafs]
    made, levels = np.zeros(len(min_leafs), np.int64), [[] for _ in min_leafs]
    ids, sizes, alive, depth = np.array([root]), np.array([len(rows)]), np.ones((len(min_leafs), 1), bool), int(root + 1).bit_length() - 1
    while len(ids):
        sums = _totals(bag.sums, rows, sizes) if len(rows) else np.zeros((len(ids), 3))
        total = sums * bag.scale
        feature, cut, gain = (np.full(alive.shape, -1), np.zeros(alive.shape, np.int64), np.zeros(alive.shape))
        open_ = alive & (_gini(total[:, 1], total[:, 2]) > PURE) & (total[:, 0] >= 2 * np.array(min_leafs)[:, None]) & (depth < max_depth)
        large = sizes >= SUMMED_ROWS
        for summed in (True, False):
            here = open_.any(axis=0) & (large == summed)
            mine = rows if here.all() else rows[np.repeat(here, sizes)]
            which, part, i = np.flatnonzero(here), sizes[here], 0
            ends = np.cumsum(part)
            while i < len(which):
                first = ends[i] - part[i]
                j = min(max(i + 1, int(np.searchsorted(ends, first + LEVEL_ROWS, side="right"))), i + (SUMMED_NODES if summed else LEVEL_NODES))
                at, some = which[i:j], mine[first:ends[j - 1]]
                subset = _subset(seed, tree, ids[at], cols.shape[1], n_sub)
                found = (_summed_candidates(cols, some, part[i:j], bag, subset, sums[at], least) if summed
                         else _sorted_candidates(cols, some, part[i:j], bag.sums, subset, sums[at]))
                feature[:, at], cut[:, at], gain[:, at] = _choose(sums[at], *found, bag.scale, min_leafs)
                i = j
        split = open_ & (feature >= 0)
        for k in range(len(min_leafs)):
            here = np.flatnonzero(alive[k])
            child = np.where(split[k, here], made[k] + len(here) + 2 * (np.cumsum(split[k, here]) - 1), -1)
            for name, v in zip(keys, (ids[here], child, np.where(child >= 0, child + 1, -1), np.where(child >= 0, feature[k, here], -1),
                                      cut[k, here], np.where(child >= 0, gain[k, here], 0.0), total[here, 1], total[here, 2])):
                out[k][name].append(v)
            levels[k].append((made[k], made[k] + len(here)))
            made[k] += len(here)
        rows, sizes, ids, alive = _below(cols, rows, sizes, ids, split, feature, cut)
        depth += 1
    return [_merged({k: np.concatenate(v) for k, v in t.items()}, ends) for t, ends in zip(out, levels)]


def _below(cols: _Columns, rows, sizes, ids, split, feature, cut):
    """The next level: two children of every split, which several trees share where they split a node alike."""
    code = np.where(split, feature * 256 + cut, -1)
    owner = np.zeros(code.shape, np.int64)
    for k in range(len(code)):                                 # the first tree that splits the node so
        owner[k] = np.argmax(code[:k + 1] == code[k], axis=0)
    of, who = np.nonzero((split & (owner == np.arange(len(code))[:, None])).T)
    alive = np.repeat(split[:, of] & (owner[:, of] == who), 2, axis=1)
    start, part = np.cumsum(sizes) - sizes, sizes[of]
    if len(of):
        at = np.repeat(start[of] - (np.cumsum(part) - part), part) + np.arange(part.sum())
        rows, f, c = rows[at], feature[who, of], cut[who, of]
    else:
        rows, f, c = rows[:0], of, of
    if len(of) == 1:
        right = cols.right_of(rows, f[0], c[0])
        rows, sizes = np.concatenate([rows[~right], rows[right]]), np.array([len(rows) - right.sum(), right.sum()])
    else:
        below = np.repeat(np.arange(len(of)), part)
        below = 2 * below + cols.right_of(rows, f[below], c[below])
        rows = rows[np.argsort(below.astype(np.uint16) if 2 * len(of) <= 65_536 else below, kind="stable")]
        sizes = np.bincount(below, minlength=2 * len(of))
    return rows, sizes, np.stack([2 * ids[of] + 1, 2 * ids[of] + 2], axis=1).ravel(), alive


def _merged(t, levels):
    """Bottom up, equal leaves become their parent."""
    says = t["w1"] > t["w0"]
    for start, end in reversed(levels):
        p = np.arange(start, end)[t["left"][start:end] >= 0]
        l, r = t["left"][p], t["right"][p]
        p = p[(t["left"][l] < 0) & (t["left"][r] < 0) & (says[l] == says[r])]
        t["left"][p], t["right"][p], t["feature"][p], t["gain"][p] = -1, -1, -1, 0.0
    return t


def _walk(t, cols: _Columns, rows) -> np.ndarray:
    """The leaf of each of ``rows``: those of a node are parted together, the last few walk on by themselves."""
    leaf, stack, few = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))], []
    while stack:
        v, here = stack.pop()
        if t["left"][v] < 0 or len(here) < WALKED_ROWS:
            leaf[here] = v
            few.append(here)
            continue
        right = cols.right_of(rows[here], t["feature"][v], t["cut"][v])
        stack += [(t["left"][v], here[~right]), (t["right"][v], here[right])]
    going = np.concatenate(few)
    while len(going := going[t["left"][leaf[going]] >= 0]):
        v = leaf[going]
        leaf[going] = np.where(cols.right_of(rows[going], t["feature"][v], t["cut"][v]), t["right"][v], t["left"][v])
    return leaf


def _share(w0, w1):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w0 + w1 > 0, w1 / (w0 + w1), 0.0)


def _node_rows(t, tree, splits, schema: pa.Schema = _SCHEMA, **more) -> pa.Table:
    live, stack = np.zeros(len(t["node"]), bool), np.array([0])
    while len(stack):                                          # what is left of the tree after merging
        live[stack] = True
        inner = stack[t["left"][stack] >= 0]
        stack = np.concatenate([t["left"][inner], t["right"][inner]])
    n = {k: v[live] for k, v in t.items()}
    inner, ids = n["left"] >= 0, n["node"]
    at = [splits[f][b] if i else 0.0 for f, b, i in zip(n["feature"], n["cut"], inner)]
    return _out(len(ids), {"tree": np.full(len(ids), tree), "node": ids, "weight": n["w0"] + n["w1"],
                           "impurity": _gini(n["w0"], n["w1"]), "w0": n["w0"], "w1": n["w1"]} | {k: np.full(len(ids), v) for k, v in more.items()},
                {"left": t["node"][n["left"]], "right": t["node"][n["right"]], "feature": n["feature"],
                 "threshold": at, "gain": n["gain"]}, ~inner, schema)


def _out(n: int, known: dict, partly: dict, missing: np.ndarray | None = None, schema: pa.Schema = _SCHEMA) -> pa.Table:
    """``n`` rows of ``schema``: columns that are whole, that are null at ``missing``, and null ones."""
    cols = []
    for c in schema:
        if c.name in known or c.name in partly:
            v = np.asarray(known[c.name] if c.name in known else partly[c.name]).astype(c.type.to_pandas_dtype())
            cols.append(pa.array(v, c.type, mask=None if c.name in known else missing))
        else:
            cols.append(pa.nulls(n, c.type))
    return pa.Table.from_arrays(cols, schema=schema)


def _matrix(pdf: pd.DataFrame, n: int):
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, n)
    return pdf["_id"].to_numpy(), bins, pdf["label"].to_numpy(), pdf["weight"].to_numpy(), pdf["_train"].to_numpy(), pdf["_score"].to_numpy()


def _matrix_of(table: pa.Table, n: int):
    """As ``_matrix``, without an object a row."""
    bins = table["bins"].cast(pa.binary()).combine_chunks()
    start = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset] if len(bins) else 0
    bins = np.frombuffer(bins.buffers()[2], np.uint8)[start:start + len(bins) * n].reshape(-1, n)
    return (table["_id"].to_numpy(), bins, *(table[c].to_numpy() for c in ("label", "weight", "_train", "_score")))


def _weights(count, label, weight):
    return np.stack([count.astype(float), count * weight * (label == 0), count * weight * (label == 1)], axis=1)


def _top_leaf(top: dict, bins: np.ndarray) -> np.ndarray:
    """Each row's node below the split nodes of one tree's top ({node: (feature, bin, ...)})."""
    at = np.zeros(len(bins), np.int64)
    for node in sorted(top):                                   # a parent's number is smaller than its children's
        here = np.flatnonzero(at == node)
        at[here] = 2 * node + 1 + (bins[here, top[node][0]] > top[node][1])
    return at


def _grow_top(binned, n_features, n_rows, trees, n_sub, min_leaf, max_depth, seed):
    """Levels of nodes above ``SUBTREE_ROWS`` bagged rows, from histograms: {tree: {node: (feature, bin, gain, w0, w1)}}
    and the nodes as large that stay leaves ({(tree, node): (rows, w0, w1)}).  Both have at most
    trees x rows / SUBTREE_ROWS entries a level."""
    top, closed = {t: {} for t in range(trees)}, {}
    active = {(t, 0) for t in range(trees)} if n_rows * 1.1 > SUBTREE_ROWS else set()
    while active:
        now, limit = sorted(active), SUBTREE_ROWS
        by_tree: dict = {}
        for t, v in now:
            by_tree.setdefault(t, []).append(v)
        tops = {t: top[t] for t in by_tree}

        def histograms(frames):
            live: dict = {}

            def drain():
                out = []
                for (t, v), h in live.items():
                    at = np.flatnonzero(h[0])
                    out.append(pd.DataFrame({"tree": t, "node": v, "cell": at, "n": h[0][at], "w0": h[1][at], "w1": h[2][at]}))
                live.clear()
                return pd.concat(out) if out else None

            for pdf in frames:
                ids, bins, label, weight, train, _ = _matrix(pdf, n_features)
                for t, nodes in by_tree.items():
                    count = bag_counts(ids, t, seed, trees) * train
                    leaf = np.where(count > 0, _top_leaf(tops[t], bins), -1)
                    for v, sub in zip(nodes, _subset(seed, t, np.array(nodes), n_features, n_sub)):
                        rows = np.flatnonzero(leaf == v)
                        cell = (bins[rows][:, sub].astype(np.int64) + np.arange(len(sub)) * 256).ravel()
                        w = np.repeat(_weights(count[rows], label[rows], weight[rows]), len(sub), axis=0)
                        h = np.stack([np.bincount(cell, w[:, i], len(sub) * 256) for i in range(3)])
                        live[t, v] = live[t, v] + h if (t, v) in live else h
                        if len(live) >= LIVE_SUMS:
                            yield drain()
            if (rest := drain()) is not None:
                yield rest

        def choose(pdf):
            tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            h = np.zeros((3, n_sub, 256))
            h.reshape(3, -1)[:, pdf["cell"].to_numpy()] = pdf[["n", "w0", "w1"]].to_numpy().T
            total, left = h[:, 0].sum(axis=1), np.cumsum(h, axis=2)
            gain = _gains(left[1], left[2], total[1], total[2])
            gain[(left[0] < min_leaf) | (total[0] - left[0] < min_leaf) | (h[0] == 0)] = -1.0
            best = _first_best(np.zeros(gain.size, np.int64), gain.ravel(), 1, np.arange(gain.size))[0]
            deep = int(node + 1).bit_length() - 1 >= max_depth
            small = total[0] <= limit
            pure = _gini(total[1], total[2]) <= PURE
            stop = best < 0 or deep or pure
            slot, cut = divmod(max(int(best), 0), 256)
            sub = _subset(seed, tree, np.array([node]), n_features, n_sub)[0]
            return pd.DataFrame({"tree": [tree], "node": [node], "kind": ["small" if small else "leaf" if stop else "split"],
                                 "feature": [int(sub[slot])], "cut": [cut], "gain": [float(gain.ravel()[best])],
                                 "n": [total[0]], "w0": [total[1]], "w1": [total[2]], "left_n": [left[0][slot, cut]]})

        summed = (binned.mapInPandas(histograms, "tree int, node int, cell int, n double, w0 double, w1 double")
                        .groupBy("tree", "node", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "w0", "w1")]))
        active = set()
        for r in summed.groupBy("tree", "node").applyInPandas(
                choose, "tree int, node int, kind string, feature int, cut int, gain double, n double, w0 double, w1 double, left_n double").collect():
            if r["kind"] == "split":
                top[r["tree"]][r["node"]] = (r["feature"], r["cut"], r["gain"], r["w0"], r["w1"])
                active |= {(r["tree"], 2 * r["node"] + 1 + side) for side, n in enumerate((r["left_n"], r["n"] - r["left_n"])) if n > limit}
            elif r["kind"] == "leaf":
                closed[r["tree"], r["node"]] = (r["n"], r["w0"], r["w1"])
    return {t: v for t, v in top.items() if v}, closed


def _merge_top(top, closed, roots):
    """Equal leaves of the tops merged: the inner nodes left, and {(tree, top leaf): the node it became}.
    ``roots``: weights of the top leaves that are leaves of the whole tree."""
    became, leaf = {}, dict(roots) | {k: v[1:] for k, v in closed.items()}
    for t, nodes in top.items():
        for v in sorted(nodes, reverse=True):
            sides = [leaf.get((t, 2 * v + 1 + s)) for s in (0, 1)]
            if all(sides) and (sides[0][1] > sides[0][0]) == (sides[1][1] > sides[1][0]):
                leaf[t, v] = nodes[v][3:]
                became |= {(t, 2 * v + 1): v, (t, 2 * v + 2): v}
    return became, leaf


def grow_forest(rows: DataFrame, train: Column, score: Column, num_trees: int, features: str, min_leaf: int,
                max_depth: int, max_bins: int, seed: int) -> Forest:
    """A forest over the ``train`` rows, and the ``score`` rows with its probability of class 1.
    ``rows`` has label (0 or 1), weight and features; its other columns pass through."""
    made = grow_forests(rows, train, score, num_trees, features, [min_leaf], max_depth, max_bins, seed)
    return Forest(made.nodes.drop("_min_leaf"), made.scored.drop("_min_leaf"), made.n_features)


def grow_forests(rows: DataFrame, train: Column, score: Column, num_trees: int, features: str, min_leafs: list[int],
                 max_depth: int, max_bins: int, seed: int) -> Forest:
    """As ``grow_forest``, a forest for each of ``min_leafs``, which ``nodes`` and ``scored`` name in ``_min_leaf``.
    The forests share split candidates, bins, bootstrap counts and, where a task grows whole trees, the dealt rows."""
    other = rows.columns
    rows = rows.withColumns({"_train": F.coalesce(train, F.lit(False)), "_score": F.coalesce(score, F.lit(False))}).where("_train OR _score")
    fitted = rows.where("_train")
    size = fitted.agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.max("label").alias("most")).first()
    if size["n"] == 0 or size["known"] < size["n"] or size["most"] > 1:
        raise ValueError("a forest needs training rows with a label of 0 or 1 each")
    if max_bins > 256:
        raise ValueError("a bin is a byte: max_bins is 256 at most")
    splits = feature_splits(fitted, size["n"], max_bins, seed)
    n_features = len(splits)
    n_sub = n_features if features == "all" else min(int(features), n_features)
    rows = stage_shared(rows.withColumn("_id", F.monotonically_increasing_id()), "forest_rows")    # the numbers are written once
    if size["n"] * 1.1 <= SUBTREE_ROWS:
        nodes, raw = _grow_whole(_blocks(rows, splits), splits, num_trees, n_sub, min_leafs, max_depth, seed)
    else:
        slim = stage_shared(_binned(rows, splits), "forest_bins")
        each = [_grow_below_top(slim, splits, size["n"], num_trees, n_sub, leaf, max_depth, seed) for leaf in min_leafs]
        nodes, votes = (reduce(DataFrame.unionByName, [d.withColumn("_min_leaf", F.lit(leaf)) for d, leaf in zip(some, min_leafs)])
                        for some in zip(*each))
        raw = votes.groupBy("_id", "_min_leaf").agg(F.sum("vote").alias("_votes"))
    p = F.col("_votes") / F.lit(float(num_trees))
    scored = rows.join(raw, "_id").select(*other, p.alias("probability"), (F.col("_votes") * 2 > num_trees).cast("double").alias("prediction"),
                                          "_min_leaf")
    return Forest(nodes, scored, n_features)


def _tasks(spark, groups: int) -> int:
    """As many tasks as groups, up to some a core, then some groups a task: these are long, their bytes few."""
    return min(groups, max(8 * spark.sparkContext.defaultParallelism, groups // 8))


def _grow_whole(blocks, splits, num_trees, n_sub, min_leafs, max_depth, seed):
    """Trees that a task grows from the root: ``TREES_A_GROUP`` trees a group, for every leaf size.  Their nodes, and each
    scored row's sum of votes (added up block by block)."""
    n_features = len(splits)

    schema = _arrow_schema(_WHOLE)

    def grow(key, table):
        group = key[0].as_py()
        ids, bins, label, weight, train_, score_, blocks = _unpacked(table, n_features)
        cols = _Columns(bins)
        made, scored = [], np.flatnonzero(score_)
        votes = np.zeros((len(min_leafs), len(scored)))
        for tree in range(group * TREES_A_GROUP, min((group + 1) * TREES_A_GROUP, num_trees)):
            count = bag_counts(ids, tree, seed, num_trees) * train_
            grown = grow_subtrees(cols, np.flatnonzero(count), _Bag.of(count, label, weight), tree, 0, seed, n_sub, min_leafs, max_depth)
            for i, (leaf, t) in enumerate(zip(min_leafs, grown)):
                made.append(_node_rows(t, tree, splits, schema, _min_leaf=leaf))
                at = _walk(t, cols, scored)
                votes[i] += _share(t["w0"][at], t["w1"][at])
        first = 0
        for block, end in blocks:
            last = int(np.searchsorted(scored, end))
            if last > first:
                made.append(pa.Table.from_pylist([{"tree": group, "_min_leaf": leaf, "block": block, "votes": votes[i, first:last].tobytes(),
                                                   "ids": ids[scored[first:last]].tobytes() if group == 0 else None}
                                                  for i, leaf in enumerate(min_leafs)], schema))
            first = last
        return pa.concat_tables(made)

    def add(key, table):
        table = table.sort_by("tree")                          # the sums' order is that of the trees
        ids = np.frombuffer(table["ids"][0].as_buffer(), np.int64)
        votes = np.zeros(len(ids))
        for v in table["votes"]:
            votes += np.frombuffer(v.as_buffer(), float)
        return pa.table({"_id": ids, "_min_leaf": np.full(len(ids), key[1].as_py(), np.int32), "_votes": votes})

    groups = -(-num_trees // TREES_A_GROUP)
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    # By number, not by its hash: every task gets as many groups as the others.
    dealt = dealt.repartitionById(_tasks(blocks.sparkSession, groups), F.col("grp"))
    grown = stage_shared(dealt.groupBy("grp").applyInArrow(grow, _WHOLE), "forest")
    raw = (grown.where("block IS NOT NULL").select("tree", "_min_leaf", "block", "ids", "votes")
                .groupBy("block", "_min_leaf").applyInArrow(add, "_id long, _min_leaf int, _votes double"))
    return grown.where("node IS NOT NULL").select(*[c.split()[0] for c in _NODE.split(", ")], "_min_leaf"), raw


def _grow_below_top(slim, splits, n_rows, num_trees, n_sub, min_leaf, max_depth, seed):
    """Trees whose top levels are split from histograms summed by Spark; a task grows one tree below one top leaf."""
    n_features = len(splits)
    top, closed = _grow_top(slim, n_features, n_rows, num_trees, n_sub, min_leaf, max_depth, seed)
    limit = SUBTREE_ROWS

    def deal(frames):
        for pdf in frames:
            ids, bins, _, _, train_, score_ = _matrix(pdf, n_features)
            for t in range(num_trees):
                leaf = _top_leaf(top.get(t, {}), bins)
                parts = np.array([int(closed[t, v][0] // limit) + 1 if (t, v) in closed else 1 for v in range(int(leaf.max(initial=0)) + 1)]
                                 if any(k[0] == t for k in closed) else [1])
                take = score_ | (train_ & (bag_counts(ids, t, seed, num_trees) > 0))
                yield pdf[take].assign(grp=t, top=leaf[take], part=(ids % parts[leaf] if len(parts) > 1 else 0 * ids)[take])

    def grow(key, table):
        tree, root = key[0].as_py(), key[1].as_py()
        ids, bins, label, weight, train_, score_ = _matrix_of(table, n_features)
        frames, votes = [], np.zeros(len(ids))
        if (tree, root) in closed:
            votes += _share(*closed[tree, root][1:])
        else:
            count = bag_counts(ids, tree, seed, num_trees) * train_
            cols = _Columns(bins)
            t, = grow_subtrees(cols, np.flatnonzero(count), _Bag.of(count, label, weight), tree, root, seed, n_sub, [min_leaf], max_depth)
            frames.append(_node_rows(t, tree, splits))
            leaf = _walk(t, cols, np.arange(len(ids)))
            votes += _share(t["w0"][leaf], t["w1"][leaf])
        made = ids[score_]
        frames.append(_out(len(made), {"tree": np.full(len(made), tree), "top": np.full(len(made), root), "_id": made, "vote": votes[score_]}, {}))
        return pa.concat_tables(frames)

    pairs = slim.mapInPandas(deal, _SLIM + ", grp int, top int, part long")
    tasks = _tasks(slim.sparkSession, num_trees + sum(map(len, top.values())))
    grown = stage_shared(pairs.repartition(tasks, "grp", "top", "part").groupBy("grp", "top", "part").applyInArrow(grow, _OUT), "forest")
    nodes, votes = grown.where("node IS NOT NULL").select(*[c.split()[0] for c in _NODE.split(", ")]), grown.where("_id IS NOT NULL")
    return _with_top(nodes, votes, top, closed, splits) if top or closed else (nodes, votes)


def _with_top(nodes, votes, top, closed, splits):
    """The nodes with those of the tops, equal leaves merged across both; a merged leaf's rows get its new share."""
    spark = nodes.sparkSession
    tips = {(t, 2 * v + 1 + s) for t, vs in top.items() for v in vs for s in (0, 1) if 2 * v + 1 + s not in vs} - set(closed)
    at = spark.createDataFrame([(int(t), int(v)) for t, v in sorted(tips)], "tree int, node int")    # bounded as the tops are
    roots = {(r["tree"], r["node"]): (r["w0"], r["w1"])
             for r in nodes.where("feature IS NULL").join(F.broadcast(at), ["tree", "node"]).collect()}
    became, leaf = _merge_top(top, closed, roots)
    made, moved = [], []
    for (t, v), (_, w0, w1) in closed.items():
        if (t, v) not in became:
            made.append((t, v, None, None, None, None, None, w0 + w1, float(_gini(w0, w1)), w0, w1))
    for t, vs in top.items():
        for v, (f, b, gain, w0, w1) in vs.items():
            if (t, v) not in became:
                inner = () if (t, v) in leaf else (2 * v + 1, 2 * v + 2, f, float(splits[f][b]), gain)
                made.append((t, v, *(inner or [None] * 5), w0 + w1, float(_gini(w0, w1)), w0, w1))
    for (t, v), to in became.items():
        while (t, to) in became:
            to = became[t, to]
        moved.append((t, v, float(_share(*map(np.float64, leaf[t, to])))))
    gone = spark.createDataFrame(moved, "tree int, node int, share double")
    nodes = nodes.join(F.broadcast(gone), ["tree", "node"], "left_anti").unionByName(spark.createDataFrame(made, _NODE))
    votes = votes.join(F.broadcast(gone.select("tree", F.col("node").alias("top"), "share")), ["tree", "top"], "left") \
                 .withColumn("vote", F.coalesce("share", "vote"))
    return nodes, votes

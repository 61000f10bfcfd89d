"""The forest grower against a plain recursive tree, and its top levels (histograms) against its subtrees."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tenure.operators import forest as FO

NAMES = ["a", "b", "c"]


def rows_of(spark, n=500, seed=1, rare=False):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        x = [rnd.randrange(40) / 4, float(rnd.randrange(2)), rnd.randrange(90) / 7]
        y = float(rnd.random() < (0.03 if rare else 0.2 + 0.6 * (x[0] > 5) * x[1]))
        data.append((i // 2, y, 3.0 if y else 1.0, "train" if i % 4 else "test", Vectors.dense(x)))
    return spark.createDataFrame(data, ["msno", "label", "weight", "split", "features"]).repartition(3)


def grown(rows, monkeypatch, subtree_rows=100_000, trees=6, features="2", min_leaf=2):
    monkeypatch.setattr(FO, "SUBTREE_ROWS", subtree_rows)
    return FO.grow_forest(rows, F.col("split") == "train", F.lit(True), trees, features, min_leaf, 30, 256, 42)


def plain_tree(data, splits, min_leaf, node=0):
    """CART over (features, label, weight) rows: {node: (feature, threshold) or class-1 share}, equal leaves merged."""
    w0, w1 = (sum(w for _, y, w in data if y == c) for c in (0, 1))
    gini = lambda p, q: 1 - (p * p + q * q) / (p + q) ** 2
    best = (1e-12, None, None)
    for f, cuts in enumerate(splits):
        for cut in cuts:
            left = [r for r in data if r[0][f] <= cut]
            if min(len(left), len(data) - len(left)) < min_leaf:
                continue
            l0, l1 = (sum(w for _, y, w in left if y == c) for c in (0, 1))
            r0, r1 = w0 - l0, w1 - l1
            gain = gini(w0, w1) - ((l0 + l1) * gini(l0, l1) + (r0 + r1) * gini(r0, r1)) / (w0 + w1)
            if gain > best[0] + 1e-13:
                best = (gain, f, cut)
    share = w1 / (w0 + w1)
    if best[1] is None:
        return {node: share}
    _, f, cut = best
    left = plain_tree([r for r in data if r[0][f] <= cut], splits, min_leaf, 2 * node + 1)
    right = plain_tree([r for r in data if r[0][f] > cut], splits, min_leaf, 2 * node + 2)
    if len(left) == len(right) == 1 and (left[2 * node + 1] > 0.5) == (right[2 * node + 2] > 0.5):
        return {node: share}
    return {node: (f, cut)} | left | right


@pytest.mark.parametrize("subtree_rows", [100_000, 40])
def test_a_single_tree_equals_a_plain_one(spark, monkeypatch, subtree_rows):
    rows = rows_of(spark)
    forest = grown(rows, monkeypatch, subtree_rows, trees=1, features="all", min_leaf=3)
    train = [(r.features.toArray(), r.label, r.weight) for r in rows.where("split = 'train'").collect()]
    values = [sorted({x[f] for x, _, _ in train}) for f in range(3)]
    expect = plain_tree(train, [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in values], 3)
    got = {r.node: r for r in forest.nodes.collect()}
    assert set(got) == set(expect)
    for node, e in expect.items():
        r = got[node]
        if isinstance(e, tuple):
            assert (r.feature, r.left, r.right) == (e[0], 2 * node + 1, 2 * node + 2) and abs(r.threshold - e[1]) < 1e-12
        else:
            assert r.feature is None and r.gain is None and abs(r.w1 / r.weight - e) < 1e-9
    for r in forest.scored.collect():
        node = 0
        while isinstance(expect[node], tuple):
            f, cut = expect[node]
            node = 2 * node + 1 + (r.features[f] > cut)
        assert abs(r.probability - expect[node]) < 1e-9 and r.prediction == float(expect[node] > 0.5)


@pytest.mark.parametrize("rare", [False, True])
def test_top_levels_change_nothing(spark, monkeypatch, rare):
    """Levels split from summed histograms give the trees that a single task grows; with a rare class
    equal leaves merge across both, and every row (repeated keys too) is scored once."""
    rows = rows_of(spark, rare=rare).checkpoint()
    whole, topped = grown(rows, monkeypatch), grown(rows, monkeypatch, subtree_rows=30)
    fill = lambda k: [tuple(-1 if x is None else x for x in r) for r in k]
    as_key = lambda f: sorted(fill([(r.tree, r.node, r.feature, r.threshold, round(r.weight, 6)) for r in f.nodes.collect()]))
    assert as_key(whole) == as_key(topped)
    p = [sorted((r.msno, r.features.toArray().tolist(), r.label, round(r.probability, 9)) for r in f.scored.collect()) for f in (whole, topped)]
    assert len(p[0]) == 500 and p[0] == p[1]


def test_large_nodes_that_cannot_split_are_dealt_in_parts(spark, monkeypatch):
    rows = rows_of(spark).withColumn("features", F.lit(0)).drop("features").crossJoin(
        spark.createDataFrame([(Vectors.dense([1.0, 1.0, 1.0]),)], ["features"]))
    forest = grown(rows, monkeypatch, subtree_rows=20)
    assert forest.nodes.count() == 6 and forest.scored.count() == 500
    assert forest.scored.select(F.round("probability", 9)).distinct().count() == 1


@pytest.mark.parametrize("subtree_rows", [100_000, 40])
def test_leaf_sizes_grown_together_equal_single_forests(spark, monkeypatch, subtree_rows):
    rows = rows_of(spark).checkpoint()
    monkeypatch.setattr(FO, "SUBTREE_ROWS", subtree_rows)
    both = FO.grow_forests(rows, F.col("split") == "train", F.lit(True), 6, "2", [2, 20], 30, 256, 42)
    plain = lambda rs: sorted(tuple(-1 if x is None else x for x in r) for r in rs)
    for leaf in (2, 20):
        one = grown(rows, monkeypatch, subtree_rows, min_leaf=leaf)
        assert "_min_leaf" not in one.nodes.columns + one.scored.columns
        for got, alone in ((both.nodes, one.nodes), (both.scored, one.scored)):
            cols = [F.round(c, 9) if t == "double" else c for c, t in alone.dtypes if c != "features"]
            assert plain(got.where(F.col("_min_leaf") == leaf).select(*cols).collect()) == plain(alone.select(*cols).collect())


def test_groups_of_trees_are_dealt_evenly(spark, monkeypatch):
    """A task of its own for every group: hashed group numbers would put several into one task."""
    made, stage = {}, FO.stage_shared

    def staged(df, name):
        made[name] = stage(df.withColumn("vote", F.spark_partition_id().cast("double")) if name == "forest" else df, name)
        return made[name]
    monkeypatch.setattr(FO, "stage_shared", staged)
    grown(rows_of(spark, n=60), monkeypatch, trees=12 * FO.TREES_A_GROUP)
    groups = made["forest"].where("node IS NOT NULL").groupBy("vote").agg(F.count_distinct("tree").alias("n")).collect()
    assert [r.n for r in groups] == [FO.TREES_A_GROUP] * 12


def test_only_columns_of_more_than_two_bins_are_sorted(monkeypatch):
    """Columns of two bins are summed over their ones; the splits are those of sorting every column."""
    rnd = np.random.default_rng(3)
    bins = np.concatenate([rnd.random((400, 9)) < 0.2, rnd.integers(0, 2, (400, 2)), np.zeros((400, 1)), rnd.integers(0, 50, (400, 2))],
                          axis=1).astype(np.uint8)
    w = FO._weights(rnd.integers(1, 4, 400), rnd.integers(0, 2, 400), np.ones(400))
    rows, sizes, subset = rnd.permutation(400), np.array([250, 1, 149]), np.tile(np.arange(14), (3, 1))
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(FO.np, "argsort", lambda a, *k, **kw: (sorted_.append(np.shape(a)), argsort(a, *k, **kw))[1])
    feature, cut, gain = FO._split_level(FO._Columns(bins), rows, sizes, w, subset, 5)
    assert max(s[0] for s in sorted_ if len(s) == 2 and s[1] == 400) == 2
    for v, part in enumerate(np.split(rows, np.cumsum(sizes)[:-1])):
        found = [(-1e-12, -1, 0)]
        for f in range(14):
            for c in np.unique(bins[part, f])[:-1]:
                l, t = w[part[bins[part, f] <= c]].sum(axis=0), w[part].sum(axis=0)
                if min(l[0], t[0] - l[0]) >= 5:
                    found.append((-float(FO._gains(l[1], l[2], t[1], t[2])), f, c))
        assert (feature[v], cut[v]) == min(found)[1:] and abs(gain[v] - max(0.0, -min(found)[0])) < 1e-11


def test_bootstrap_counts_are_poisson_and_need_only_row_and_tree():
    ids = np.arange(200_000)
    a, b = FO.bag_counts(ids, 3, 42, 10), FO.bag_counts(ids, 4, 42, 10)
    assert abs(a.mean() - 1) < 0.02 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.02
    assert (FO.bag_counts(ids[500:700], 3, 42, 10) == a[500:700]).all()


def test_split_candidates_follow_the_weighted_counts(spark):
    rows = spark.range(1000).selectExpr("cast(id as double) AS x", "cast(1 as double) AS weight", "id % 2 AS two")
    made = rows.rdd.map(lambda r: (Vectors.dense([r.x, float(r.two)]), r.weight)).toDF(["features", "weight"])
    x, two = FO.feature_splits(made, 1000, 8, 1)
    assert len(x) == 7 and max(abs(v - 124.5 - 125 * i) for i, v in enumerate(x)) <= 1.0 and two.tolist() == [0.5]


def test_no_training_rows_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        grown(rows_of(spark).where("split = 'test'"), monkeypatch)


def random_rows(n=3000, seed=4):
    rnd = np.random.default_rng(seed)
    hot = np.eye(7)[rnd.integers(0, 7, n)]
    bins = np.concatenate([hot, rnd.random((n, 2)) < 0.4, rnd.integers(0, 200, (n, 3))], axis=1).astype(np.uint8)
    label = (rnd.random(n) < 0.2 + 0.6 * (bins[:, 9] > 90) * (1 - bins[:, 2])).astype(float)
    return bins, label, rnd.integers(0, 4, n)


def trees_of(bins, label, count, weight, leafs, monkeypatch=None, summed_rows=128):
    if monkeypatch:
        monkeypatch.setattr(FO, "SUMMED_ROWS", summed_rows)
    cols = FO._Columns(bins)
    return cols, FO.grow_subtrees(cols, np.flatnonzero(count), FO._Bag.of(count, label, weight), 1, 0, 42, 6, leafs, 30)


@pytest.mark.parametrize("weights", ["class", "boosted", "some zero"])
def test_nodes_split_by_histograms_are_those_split_by_sorting(monkeypatch, weights):
    """Weights are whole numbers, so that both add up the same whatever the order."""
    bins, label, count = random_rows()
    rnd = np.random.default_rng(9)
    weight = {"class": np.where(label > 0, 3.0, 1.0), "boosted": rnd.integers(1, 50, len(label)) * 1.0,
              "some zero": rnd.integers(0, 3, len(label)) * 1.0}[weights]
    for leafs in ([1], [2, 5, 40]):
        _, summed = trees_of(bins, label, count, weight, leafs, monkeypatch, 1)
        _, sorted_ = trees_of(bins, label, count, weight, leafs, monkeypatch, 10**9)
        for a, b in zip(summed, sorted_):
            assert len(a["node"]) > 30 and all((a[k] == b[k]).all() for k in a)


def test_large_nodes_are_not_sorted(monkeypatch):
    bins, label, count = random_rows()
    sorted_, found = [], FO._sorted_candidates
    monkeypatch.setattr(FO, "_sorted_candidates", lambda c, rows, sizes, *a: (sorted_.extend(sizes), found(c, rows, sizes, *a))[1])
    trees_of(bins, label, count, np.ones(len(label)), [1])
    assert sorted_ and max(sorted_) < FO.SUMMED_ROWS


def test_leaf_sizes_split_a_node_once_and_grow_the_trees_of_each_alone(monkeypatch):
    bins, label, count = random_rows()
    weight, seen, found = np.where(label > 0, 3.0, 1.0), [], FO._summed_candidates
    monkeypatch.setattr(FO, "_summed_candidates", lambda c, rows, *a: (seen.append(len(rows)), found(c, rows, *a))[1])
    _, together = trees_of(bins, label, count, weight, [3, 6, 10, 20], monkeypatch, 1)
    once = sum(seen)
    for leaf, t in zip([3, 6, 10, 20], together):
        _, (alone,) = trees_of(bins, label, count, weight, [leaf])
        assert all((t[k] == alone[k]).all() for k in t)
    assert once < 0.6 * (sum(seen) - once)


def test_one_hot_columns_share_a_byte_and_rows_walk_by_the_bins():
    bins, label, count = random_rows()
    cols, (t,) = trees_of(bins, label, count, np.ones(len(label)), [2])
    assert len(cols.two) == 9 and cols.shared <= 3
    leaf, at = FO._walk(t, cols, np.arange(len(bins))), np.zeros(len(bins), int)
    for _ in range(31):
        inner = t["left"][at] >= 0
        right = bins[np.arange(len(bins)), t["feature"][at]] > t["cut"][at]
        at = np.where(inner, np.where(right, t["right"][at], t["left"][at]), at)
    assert (leaf == at).all()


def test_rows_are_dealt_in_blocks(spark, monkeypatch):
    """A record a batch of rows and group of trees, not one a row; the votes of a block are added up together."""
    dealt, deal = [], FO._blocks
    monkeypatch.setattr(FO, "_blocks", lambda rows, splits: (dealt.append(deal(rows, splits).count()), deal(rows, splits))[1])
    forest = grown(rows_of(spark), monkeypatch)
    assert dealt and dealt[0] <= 16 and forest.scored.count() == 500
    ids = FO.stage_shared(forest.scored, "scored")
    assert ids.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0


def test_folds_without_scored_rows_in_some_blocks_and_few_rows(spark, monkeypatch):
    rows = rows_of(spark, n=12).repartition(6)
    made = FO.grow_forest(rows, F.col("split") == "train", F.col("split") == "test", 5, "2", 1, 30, 256, 42)
    assert made.scored.count() == 3 and made.nodes.select("tree").distinct().count() == 5

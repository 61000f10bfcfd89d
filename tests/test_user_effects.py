"""The regression over user ids against a dense numpy fit of the same loss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import user_effects as UE

SCHEMA = "k string, u long, x double, z double, y int"
NUM = ["x", "z"]


def table_of(spark, data):
    return UE.scaled_rows(spark.createDataFrame(data, SCHEMA), NUM, "k", "u", "y")


def sample(n=400, seed=3):
    """User 1 holds a third of the rows; some rows have no user, a number or a label missing."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        u = rnd.choice([1, 1, 1, 1, rnd.randrange(2, 12), rnd.randrange(2, 12), rnd.randrange(2, 60), rnd.randrange(2, 60), None])
        x = rnd.uniform(-5, 9)
        y = int(rnd.random() < (0.8 if (u or 0) % 3 == 1 else 0.3))
        data.append((f"r{i}", u, None if i % 50 == 7 else x, float(i % 4), None if i % 90 == 5 else y))
    return data


def dense_optimum(rows, c):
    """Plain Newton over a dense one-hot design (training rows)."""
    train = [r for r in rows if r.split == "train"]
    users = sorted({r.u for r in train if r.u is not None})
    a = np.array([[r.x, r.z, 1.0] + [float(r.u == u) for u in users] for r in train])
    y = np.array([r.y for r in train])
    penalty = np.array([1.0, 1.0, 0.0] + [1.0] * len(users))
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(c * (a.T * (p * (1 - p))) @ a + np.diag(penalty), c * a.T @ (p - y) + penalty * w)
    return w, users


@pytest.mark.parametrize("c", [0.5, 200.0])
def test_weights_equal_a_dense_fit(spark, c):
    rows = table_of(spark, sample()).cache()
    model = UE.fit(rows, NUM, "k", "u", "y", c=c, part_rows=10)       # the hot user is dealt into many parts
    w, users = dense_optimum(rows.collect(), c)
    assert np.allclose([model.weights[x] for x in ("x", "z", "intercept")], w[:3], atol=1e-6)
    got = {r.u: r for r in model.users.collect()}
    assert sorted(got) == users
    assert np.allclose([got[u].weight for u in users], w[3:], atol=1e-6)
    assert max(abs(r.gradient) for r in got.values()) < 1e-6
    assert max(abs(t["gradient"]) for t in model.totals.values()) < 1e-6
    by_feature = {r.feature: r for r in UE.optimality(model, rows, NUM, "u").collect()}
    n_users = rows.where("u IS NOT NULL").select("u").distinct().count()
    assert set(by_feature) == {"x", "z", "intercept"} | {f"u@{i + 1}" for i in range(n_users)}
    scored = {r.k: r for r in UE.scores(model, rows, NUM, "k", "u", "y").collect()}
    assert len(scored) == rows.count()
    r = next(r for r in rows.collect() if r.u is None)                # no user, no user weight
    eta = r.x * w[0] + r.z * w[1] + w[2]
    assert abs(scored[r.k].p1 - 1 / (1 + np.exp(-eta))) < 1e-6
    rows.unpersist()


def test_optimum_with_hardly_a_penalty(spark):
    """Few rows, columns of very different sizes, almost separable."""
    data = [(f"a{i}", 1 + i % 3, float(i), float(i % 2) * 1e6, int(i > 20)) for i in range(60)]
    rows = table_of(spark, data)
    model = UE.fit(rows, NUM, "k", "u", "y", c=1e5, tolerance=1e-3)
    assert model.steps < UE.MAX_STEPS
    assert max(abs(t["gradient"]) for t in model.totals.values()) < 1e-3
    assert model.users.where(F.abs("gradient") >= 1e-3).count() == 0


def test_design_lists_every_non_zero_once(spark):
    rows = table_of(spark, sample(80)).cache()
    made = UE.sparse_design(rows, NUM, "k", "u").collect()
    users = sorted({r.u for r in rows.collect() if r.u is not None})
    expect = set()
    for r in rows.collect():
        expect |= {(r.k, i, n, r[n]) for i, n in enumerate(NUM) if r[n]}
        if r.u is not None:
            at = users.index(r.u)
            expect.add((r.k, len(NUM) + at, f"u@{at + 1}", 1.0))
    assert len(made) == len(expect) and {(r.k, r.position, r.feature, r.value) for r in made} == expect
    rows.unpersist()


def test_empty_table(spark):
    rows = table_of(spark, [])
    model = UE.fit(rows, NUM, "k", "u", "y")
    assert model.weights == {"x": 0.0, "z": 0.0, "intercept": 0.0} and model.users.count() == 0
    assert UE.sparse_design(rows, NUM, "k", "u").count() == 0
    assert {r.feature for r in UE.optimality(model, rows, NUM, "u").collect()} == {"x", "z", "intercept"}


def test_a_pass_moves_weights_and_not_rows(spark, monkeypatch):
    """The rows are dealt out once; a pass shuffles by user what the join with the weights needs, never the rows."""
    plans = []
    stage = UE.stage_shared

    def spy(df, name):
        if name == "user_sums":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(UE, "stage_shared", spy)
    rows = table_of(spark, sample(200)).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        UE.fit(rows, NUM, "k", "u", "y", part_rows=10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows.unpersist()
    assert len(plans) > 1
    for plan in plans:
        kept = [line for line in plan.splitlines() if "Exchange" in line]
        # the weights by (user, part) and the sums by user: none by the rows' own keys
        assert len(kept) == 2 and not any("_user" in line and "_part#" in line for line in kept), plan

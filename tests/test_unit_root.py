"""Simulated null distribution of the unit-root statistic against published critical values and a plain count."""

import numpy as np
import pytest

from tenure.operators import timeseries as TS


def published(level, n):
    b = TS.ADF_CRIT_CONSTANT[level]
    return b[0] + b[1] / n + b[2] / n**2 + b[3] / n**3


def test_simulated_points_agree_with_the_published_ones(spark):
    null = TS.null_distribution(spark, [100, 250], draws=1_000_000)
    points = {(r["length"], r["share"]): r["point"] for r in TS.critical_points(null, [0.01, 0.05, 0.10]).collect()}
    for n in (100, 250):
        for level, share in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
            assert points[n, share] == pytest.approx(published(level, n), abs=0.01)


def test_statistic_is_that_of_a_regression():
    step = np.random.default_rng(3).standard_normal((1, 40))
    got = TS.null_statistics(np.random.default_rng(3), 1, 40)[0]
    x = np.concatenate([[0.0], np.cumsum(step[0])])
    design = np.column_stack([x[:-1], np.ones(40)])
    beta, rss, *_ = np.linalg.lstsq(design, np.diff(x), rcond=None)
    se = np.sqrt(rss[0] / 38 * np.linalg.inv(design.T @ design)[0, 0])
    assert got == pytest.approx(beta[0] / se, rel=1e-9)


def test_p_values_are_shares_of_the_simulation(spark):
    rows = [("a", 250, -3.5), ("b", 250, -1.0), ("c", 240, 0.4), ("d", 30, -50.0), ("e", 9000, 60.0), ("f", 250, None)]
    tested = spark.createDataFrame(rows, "msno string, nobs bigint, adf_stat double")
    got = {r["msno"]: r["p_value"] for r in TS.with_p_values(tested, draws=20_000).collect()}
    assert got["f"] is None and got["d"] == 0.0 and got["e"] == 1.0
    assert 0.003 < got["a"] < 0.015 and got["a"] < got["b"] < got["c"] < 1
    tau = np.concatenate([TS.null_statistics(np.random.default_rng([7, 3 * k + 1]), TS.NULL_BLOCK, 250) for k in range(10)])
    assert got["b"] == np.mean(np.floor(tau * TS.NULL_BINS) <= -1000)
    none = TS.with_p_values(tested.limit(0))
    assert none.columns == ["msno", "nobs", "adf_stat", "p_value"] and none.count() == 0

"""Per-user time-series diagnostics for all users at once.

The reference decomposes and tests one hand-picked user.  Here the daily
series of every user is built on a calendar (gaps = 0), and each user's
series is one window partition: its length is the calendar length, not the
user's share of the data, so a heavy user does not make a heavy partition.

E8  additive decomposition with a centred moving average (period m).
E9a Dickey-Fuller regression without lagged differences, from regr_* aggregates.
E9b augmented Dickey-Fuller with the lag chosen by AIC: one aggregation gives each
    user's cross-products, a small matrix whose columns are taken out one by one.
E9c p-values of E9a from a simulated null distribution: random walks are drawn in
    blocks over all tasks, and only counts per bin of the statistic come together.
"""

from __future__ import annotations

import datetime as _dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.operators.eda import calendar_fill
from tenure.session import stage_shared

# MacKinnon (2010), response-surface critical values of the Dickey-Fuller tau
# statistic, constant and no trend, one variable: c(n) = b0 + b1/n + b2/n^2 + b3/n^3.
ADF_CRIT_CONSTANT = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def daily_series(logs: DataFrame, first_day: _dt.date, n_days: int, value_col: str = "num_25") -> DataFrame:
    """Every log user's value on every calendar day (gaps 0), with t = 0..n-1."""
    users = logs.select("msno").distinct()
    s = calendar_fill(logs, users, first_day, n_days, value_col)
    return s.withColumn("t", F.datediff("date", F.lit(first_day)))


def seasonal_decompose(series: DataFrame, period: int, value_col: str = "num_25") -> DataFrame:
    """observed = trend + seasonal + resid (additive), per user.

    Trend: centred moving average; for even m the two end points weigh 1/2.
    NULL where the window does not fit in the series.  Seasonal: mean of the
    detrended values per phase (t mod m, NULLs skipped), minus the mean of
    those phase means.  Residual: observed - trend - seasonal.
    """
    m, h = period, period // 2
    x = F.col("observed")
    w = Window.partitionBy("msno").orderBy("t")
    n_user = F.max("t").over(Window.partitionBy("msno")) + 1
    frame_sum = F.sum(x).over(w.rowsBetween(-h, h))
    if m % 2 == 0:
        ends = F.lag(x, h).over(w) + F.lead(x, h).over(w)
        trend = (frame_sum - 0.5 * ends) / F.lit(float(m))
    else:
        trend = frame_sum / F.lit(float(m))
    complete = (F.col("t") >= h) & (F.col("t") <= n_user - 1 - h)
    d = (series.select("msno", "date", "t", F.col(value_col).cast("double").alias("observed"))
               .withColumn("trend", F.when(complete, trend))
               .withColumn("phase", F.col("t") % m))
    # Phase means are windows inside the user's series, then one value per phase: no join, no other exchange.
    phase_mean = F.avg(F.col("observed") - F.col("trend")).over(Window.partitionBy("msno", "phase"))
    d = d.withColumn("_pm", phase_mean)
    first_of_phase = F.when(F.col("t") < m, F.col("_pm"))      # t = 0..m-1 are the phases, each once
    out = d.withColumn("seasonal", F.col("_pm") - F.avg(first_of_phase).over(Window.partitionBy("msno")))
    return out.select("msno", "date", "t", "observed", "trend", "seasonal",
                      (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"))


def unit_root_lag0(series: DataFrame, value_col: str = "num_25") -> DataFrame:
    """Per user, regress dx_t on x_{t-1} with a constant; tau = slope / se(slope).

    Sums of squares come from ``regr_*`` aggregates (partial aggregation, no
    per-user collect).  NULL when the lagged level has no variance or n < 3.
    """
    w = Window.partitionBy("msno").orderBy("t")
    x = F.col(value_col).cast("double")
    d = series.select("msno", "t", x.alias("x")).withColumn("x_lag", F.lag("x").over(w)) \
              .withColumn("dx", F.col("x") - F.col("x_lag")).filter(F.col("x_lag").isNotNull())
    g = d.groupBy("msno").agg(F.regr_count("dx", "x_lag").alias("n"),
                              F.regr_sxx("dx", "x_lag").alias("sxx"),
                              F.regr_syy("dx", "x_lag").alias("syy"),
                              F.regr_sxy("dx", "x_lag").alias("sxy"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(rss, (F.col("n") - 2).cast("double")), F.col("sxx")))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 0)
    tau = F.when(ok & (se > 0), slope / se)
    out = g.select("msno", F.col("n").cast("long").alias("nobs"), F.when(ok, slope).alias("slope"),
                   tau.alias("adf_stat"))
    for level, b in ADF_CRIT_CONSTANT.items():
        n = F.col("nobs").cast("double")
        out = out.withColumn(f"crit_{level.rstrip('%')}",
                             F.lit(b[0]) + F.lit(b[1]) / n + F.lit(b[2]) / (n * n) + F.lit(b[3]) / (n * n * n))
    return out


# --- E9b: lag-selected ADF, from one aggregation of cross-products ---------------

RANK_TOL = 1e-9     # a column of which the others leave less than this share is explained by them


def lag_limit(n: int) -> int:
    """The longest lag tried on ``n`` values: 12 (n/100)^(1/4) rounded up, half the series at most."""
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def lagged_products(series: DataFrame, value_col: str, longest: int) -> DataFrame:
    """A row per user: sums and products of the regression's columns over the rows that every lag allows.

    Columns: the level before the step, the steps 1 to ``longest`` days earlier, the step.  Levels are
    taken from the user's mean, which the constant absorbs.  ``head`` holds the values before those
    rows (``lag_limit`` + 1 of them), from which the rows that a shorter lag adds can be rebuilt.
    """
    user = Window.partitionBy("msno")
    x = F.coalesce(F.col(value_col).cast("double"), F.lit(0.0))
    d = series.select("msno", x.alias("x"), (F.row_number().over(user.orderBy("t")) - 1).alias("row"),
                      F.count(F.lit(1)).over(user).alias("n"), F.avg(x).over(user).alias("mean"))
    limit = F.least(F.ceil(12.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)
    level = [F.lag("x", j).over(user.orderBy("row")).alias(f"x{j}") for j in range(1, longest + 2)]
    d = d.select("msno", "n", "row", (F.col("x") - F.col("mean")).alias("x"),
                 F.greatest(F.lit(0), limit).cast("int").alias("limit")).select("*", *level)
    cols = ([F.col("x1")] + [F.col(f"x{j}") - F.col(f"x{j + 1}") for j in range(1, longest + 1)]
            + [F.col("x") - F.col("x1")])
    inside = F.col("row") > F.col("limit")
    names = [f"c{i}" for i in range(len(cols))]
    d = d.select("msno", "n", "limit", F.when(~inside, F.struct("row", "x")).alias("head"),
                 *[F.when(inside, c).alias(name) for c, name in zip(cols, names)])
    products = [F.expr(f"sum({a} * {b})") for i, a in enumerate(names) for b in names[i:]]
    return d.groupBy("msno", "n", "limit").agg(
        F.array(*[F.sum(c) for c in names]).alias("sums"), F.array(*products).alias("products"),
        F.sort_array(F.collect_list("head")).getField("x").alias("head"))


def _without(a: np.ndarray, scale: np.ndarray, k: int) -> np.ndarray | None:
    """``a`` after regressing every column on column ``k``; None where earlier columns explain ``k``."""
    if not a[k, k] > RANK_TOL * scale[k]:
        return None
    return a - np.outer(a[:, k], a[k]) / a[k, k]


def best_lag(a: np.ndarray, rows: int, limit: int) -> int:
    """The lag of least AIC: taking the columns out one after the other gives every lag's residual sum."""
    scale, best, least = a.diagonal().copy(), 0, np.inf
    for lag in range(limit + 1):
        a = _without(a, scale, lag)
        if a is None:
            break
        aic = rows * np.log(a[-1, -1]) + 2 * lag if a[-1, -1] > RANK_TOL * scale[-1] else -np.inf
        if aic < least:
            best, least = lag, aic
    return best


def adf_statistic(a: np.ndarray, rows: int) -> float | None:
    """slope / se(slope) of the level (column 0); None where it is not defined or the fit is exact."""
    scale, free = a.diagonal().copy(), rows - len(a)
    for k in range(1, len(a) - 1):
        a = _without(a, scale, k)
        if a is None:
            return None
    if free <= 0 or not a[0, 0] > RANK_TOL * scale[0]:
        return None
    left = a[-1, -1] - a[0, -1] ** 2 / a[0, 0]
    return float(a[0, -1] / np.sqrt(left / free * a[0, 0])) if left > RANK_TOL * scale[-1] else None


def adf_of_products(n: int, limit: int, sums: np.ndarray, products: np.ndarray, head: np.ndarray) -> tuple:
    """(statistic, lag, rows) of one user's sums (see ``lagged_products``)."""
    width, rows = len(sums), max(0, n - 1 - limit)
    raw = np.zeros((width, width))
    raw[np.triu_indices(width)] = products
    raw = np.triu(raw) + np.triu(raw, 1).T
    use = [*range(limit + 1), width - 1]
    raw, sums = np.nan_to_num(raw[np.ix_(use, use)]), np.nan_to_num(sums[use])
    lag = best_lag(raw - np.outer(sums, sums) / max(rows, 1), rows, limit)
    use = [*range(lag + 1), len(use) - 1]
    raw, sums, step = raw[np.ix_(use, use)], sums[use], np.diff(head)     # step[i]: from value i to value i + 1
    for t in range(lag + 1, min(limit + 1, n)):                         # the rows that the shorter lag adds
        row = np.array([head[t - 1], *(step[t - 1 - j] for j in range(1, lag + 1)), step[t - 1]])
        raw, sums, rows = raw + np.outer(row, row), sums + row, rows + 1
    return adf_statistic(raw - np.outer(sums, sums) / max(rows, 1), rows), lag, rows


def unit_root_adf(series: DataFrame, value_col: str = "num_25", days: int | None = None) -> DataFrame:
    """ADF with a constant for every user, lag by AIC on the rows that the longest lag allows.

    One window and one aggregation by user give the cross-products; only those (a small matrix a user)
    reach Python.  ``days`` is the length of the longest series, counted where it is not given.  A null
    value counts as 0, like a missing day; a series without variance, too short or fitted exactly has a
    null statistic.
    """
    if days is None:
        days = series.groupBy("msno").count().agg(F.max("count")).first()[0]
    key_type = dict(series.dtypes)["msno"]

    def solve(batches):
        for batch in batches:
            found = [adf_of_products(int(n), int(limit), np.array(sums, dtype=float), np.array(products, dtype=float),
                                     np.array(head, dtype=float))
                     for n, limit, sums, products, head in zip(batch["n"], batch["limit"], batch["sums"],
                                                               batch["products"], batch["head"])]
            yield pd.DataFrame({"msno": batch["msno"], "adf_stat": pd.array([f[0] for f in found], dtype="Float64"),
                                "used_lag": [f[1] for f in found], "nobs": [f[2] for f in found]})

    out = lagged_products(series, value_col, lag_limit(int(days or 0))).mapInPandas(
        solve, f"msno {key_type}, adf_stat double, used_lag int, nobs int")
    n = F.when(F.col("nobs") > 0, F.col("nobs").cast("double"))
    return out.select("*", *[(b[0] + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n)).alias(f"crit_{level.rstrip('%')}")
                             for level, b in ADF_CRIT_CONSTANT.items()])


# --- E9c: p-values from a simulated null distribution ---------------------------

NULL_LENGTHS = [25, 50, 100, 250, 500, 1000]    # a series is judged by the nearest of these lengths
NULL_DRAWS, NULL_BLOCK = 200_000, 2_000
NULL_BINS = 1000            # to a unit of the statistic
NULL_RANGE = 20             # the statistic is clipped at plus and minus this


def null_statistics(rng: np.random.Generator, draws: int, nobs: int) -> np.ndarray:
    """The lag-0 statistic (with a constant) of ``draws`` random walks with ``nobs`` steps."""
    step = rng.standard_normal((draws, nobs))
    level = np.cumsum(step, axis=1) - step          # the level before each step
    level -= level.mean(axis=1, keepdims=True)
    step -= step.mean(axis=1, keepdims=True)
    sxx, syy, sxy = (np.einsum("ij,ij->i", a, b) for a, b in ((level, level), (step, step), (level, step)))
    return sxy / np.sqrt(sxx * (syy - sxy * sxy / sxx) / (nobs - 2))


def null_distribution(spark: SparkSession, lengths: list[int], draws: int = NULL_DRAWS, seed: int = 7) -> DataFrame:
    """(length, bin, n, below, total): how the statistic falls where every series is a random walk.

    A block of draws is a row and has its own seed, so retries repeat it; blocks add up to counts per
    bin (2 x ``NULL_RANGE`` x ``NULL_BINS`` for each length at most, whatever the number of draws).
    """
    blocks = -(-draws // NULL_BLOCK)
    given = spark.range(blocks * len(lengths), numPartitions=max(1, blocks * len(lengths) // 8)).select(
        "id", F.get(F.array(*[F.lit(n) for n in lengths]), (F.col("id") % len(lengths)).cast("int")).alias("length"))

    def simulate(batches):
        for batch in batches:
            for block, length in zip(batch["id"], batch["length"]):
                tau = null_statistics(np.random.default_rng([seed, int(block)]), NULL_BLOCK, int(length))
                bins, n = np.unique(np.floor(np.clip(tau, -NULL_RANGE, NULL_RANGE) * NULL_BINS).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"length": np.int32(length), "bin": bins, "n": n})

    counts = given.mapInPandas(simulate, "length int, bin bigint, n bigint").groupBy("length", "bin").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("length")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stage_shared(counts.select("length", "bin", "n", F.sum("n").over(upto).alias("at_most"), F.sum("n").over(every).alias("total")),
                        "adf_null")


def critical_points(null: DataFrame, shares: list[float]) -> DataFrame:
    """(length, share, point): below ``point`` lies that share of the simulated statistics."""
    wanted = F.explode(F.array(*[F.lit(x) for x in shares])).alias("share")
    return null.select("length", "bin", "at_most", "total", wanted).where(F.col("at_most") >= F.col("share") * F.col("total")).groupBy(
        "length", "share").agg(((F.min("bin") + 1) / NULL_BINS).alias("point"))


def with_p_values(tested: DataFrame, draws: int = NULL_DRAWS) -> DataFrame:
    """``tested`` (``nobs``, ``adf_stat``) with ``p_value``, the share of simulated random walks of about the same
    length whose statistic is at most the series' own; null without a statistic."""
    length = F.lit(NULL_LENGTHS[-1])
    for small, large in reversed(list(zip(NULL_LENGTHS, NULL_LENGTHS[1:]))):
        length = F.when(F.col("nobs") * 2 < small + large, F.lit(small)).otherwise(length)
    keyed = tested.withColumn("length", length).withColumn("bin", F.when(F.col("adf_stat").isNotNull(), F.floor(
        F.greatest(F.lit(-NULL_RANGE), F.least(F.lit(NULL_RANGE), F.col("adf_stat"))) * NULL_BINS)))
    lengths = [r[0] for r in keyed.where("adf_stat is not null").select("length").distinct().collect()]      # of NULL_LENGTHS
    if not lengths:
        return keyed.drop("length", "bin").withColumn("p_value", F.lit(None).cast("double"))
    null = null_distribution(tested.sparkSession, sorted(lengths), draws)
    # Every bin of a length, empty ones too, so that the join is by equality.
    bins = null.groupBy("length").agg(F.min("bin").alias("lo"), F.max("total").alias("total"))
    whole = bins.select("length", "total", F.explode(F.sequence(F.lit(-NULL_RANGE * NULL_BINS), F.lit(NULL_RANGE * NULL_BINS))).alias("bin"))
    upto = Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = whole.join(null.select("length", F.col("bin").cast("int").alias("bin"), "n"), ["length", "bin"], "left").select(
        "length", F.col("bin").cast("bigint").alias("bin"), (F.sum(F.coalesce("n", F.lit(0))).over(upto) / F.col("total")).alias("p_value"))
    return keyed.join(F.broadcast(shares), ["length", "bin"], "left").drop("length", "bin")   # lengths x bins rows at most

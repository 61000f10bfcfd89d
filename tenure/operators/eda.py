"""Churn exploration: cross-tabs, churn rates, bins, histograms, two-level stats.

D1, D4, D14-D17, F1-F6, B3, C3, C4, C7.  Each report is a chain of grouped
aggregations (per user, then per value, then per bin); the per-value and
per-bin tables are small, and nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.bins import bin_spine, equal_width_bin, explicit_bin, interval_labels, label_of
from tenure.functions.windows import prefix_sums
from tenure.operators.logs import normalised_counters, repeat_columns

# Fixed values of the reference's reports.
CONSISTENT_LABELS = ["<10", "10-20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80",
                     "80-90", ">90"]
AGE_EDGES = [0, 12, 25, 35, 45, 65, 80]


def churn_crosstab(df: DataFrame, value_col: str, label_col: str = "is_churn") -> DataFrame:
    """D14 + D15: users per (value, class) as two typed columns, and the churn rate in %."""
    ct = df.filter(F.col(label_col).isNotNull()).groupBy(value_col).agg(
        F.count_if(F.col(label_col) == 0).alias("n_retained"),
        F.count_if(F.col(label_col) == 1).alias("n_churned"))
    return ct.withColumn("churn_rate",
                         F.col("n_churned") * 100.0 / (F.col("n_retained") + F.col("n_churned")))


def discount_churn(tx: DataFrame, train: DataFrame) -> DataFrame:
    """D17 (+B3, D1, C4): churn rate by number of undiscounted transactions, over users
    with at least one discounted transaction.

    Transactions are counted per user first; the label joins one row per user,
    and users without one drop out (the reference's inner merge).
    """
    discounted = (F.col("plan_list_price") - F.col("actual_amount_paid")) > 0
    per_user = (tx.groupBy("msno").agg(F.count(F.lit(1)).alias("_n"), F.count_if(discounted).alias("_n_discount"))
                  .filter(F.col("_n_discount") > 0)
                  .join(train.select("msno", "is_churn").filter(F.col("is_churn").isNotNull()), "msno")
                  .withColumn("no_discount_transactions", F.col("_n") - F.col("_n_discount")))
    return churn_crosstab(per_user, "no_discount_transactions")


def binned_churn_rate(features: DataFrame, train: DataFrame, value_col: str, n_bins: int,
                      labels: list[str] | None = None) -> DataFrame:
    """D14 + D15 + F1 + F3 + F4: mean churn rate per equal-width bin of the distinct values.

    The mean is unweighted over distinct values (as the reference averages the
    cross-tab's ratio column); empty bins appear with a NULL mean.
    """
    lab = features.select("msno", value_col).join(train.select("msno", "is_churn"), "msno")
    ct = churn_crosstab(lab, value_col)
    b, lo, hi = equal_width_bin(ct, value_col, n_bins)
    per_bin = (ct.select(b.alias("bin"), "churn_rate")
                 .groupBy("bin").agg(F.avg("churn_rate").alias("mean_churn_rate"),
                                     F.count(F.lit(1)).alias("n_values")))
    spine = bin_spine(ct, n_bins)
    mn = ct.select(F.min(F.col(value_col).cast("double"))).scalar()
    mx = ct.select(F.max(F.col(value_col).cast("double"))).scalar()
    w = (mx - mn) / F.lit(float(n_bins))
    out = spine.join(per_bin, "bin", "left").select(
        "bin",
        (mn + (F.col("bin") - 1) * w).alias("lower_edge"),
        (mn + F.col("bin") * w).alias("upper_edge"),
        "mean_churn_rate",
        F.coalesce("n_values", F.lit(0)).alias("n_values"))
    if labels:
        out = out.withColumn("bin_label", label_of("bin", labels))
    return out


def age_churn_bins(member_features: DataFrame, train: DataFrame,
                   edges: list[float] = AGE_EDGES) -> DataFrame:
    """F2 + F4: mean churn rate (over distinct ages) per explicit age bin; empty -> NULL."""
    lab = member_features.select("msno", "bd").join(train.select("msno", "is_churn"), "msno")
    ct = churn_crosstab(lab, "bd")
    per_bin = (ct.select(explicit_bin("bd", edges).alias("bin"), "churn_rate")
                 .filter(F.col("bin").isNotNull())
                 .groupBy("bin").agg(F.avg("churn_rate").alias("mean_churn_rate")))
    n = len(edges) - 1
    return (bin_spine(ct, n).join(per_bin, "bin", "left")
              .select("bin", label_of("bin", interval_labels(edges)).alias("age_bin"),
                      "mean_churn_rate"))


def age_group_counts(member_features: DataFrame, cancel_counts: DataFrame,
                     edges: list[float] = AGE_EDGES) -> DataFrame:
    """F2 + F5: users per age bin counted by non-null ``cancelled_counts``; empty -> 0."""
    j = member_features.select("msno", "bd").join(cancel_counts.select("msno", "cancelled_counts"),
                                                  "msno", "left")
    per_bin = (j.select(explicit_bin("bd", edges).alias("bin"), "cancelled_counts")
                .filter(F.col("bin").isNotNull())
                .groupBy("bin").agg(F.count("cancelled_counts").alias("n_users")))
    n = len(edges) - 1
    return (bin_spine(j, n).join(per_bin, "bin", "left")
              .select("bin", label_of("bin", interval_labels(edges)).alias("age_group"),
                      F.coalesce("n_users", F.lit(0)).alias("n_users")))


def rate_histogram(values: DataFrame, value_col: str, edges: DataFrame, edge_col: str) -> DataFrame:
    """histogram counts of ``value_col`` over the sorted distinct ``edge_col`` values.

    numpy rules: bins [e_k, e_k+1) with the last bin closed.  Values are
    collapsed to one row per distinct value first, then merged with the edges
    in one sorted pass; a value's bin is the number of edges at or below it,
    so no value is compared with every edge.
    """
    e = edges.select(F.col(edge_col).cast("double").alias("v")).distinct() \
             .select("v", F.lit(0).cast("long").alias("n_values"), F.lit(1).alias("is_edge"))
    v = values.select(F.col(value_col).cast("double").alias("v")).filter(F.col("v").isNotNull()) \
              .groupBy("v").agg(F.count(F.lit(1)).alias("n_values")).withColumn("is_edge", F.lit(0))
    # One row per distinct point, so that no tie is left to the running sum.
    points = e.unionByName(v).groupBy("v").agg(F.sum("n_values").alias("n_values"), F.max("is_edge").alias("is_edge"))
    ranked = prefix_sums(points, ["v"], ["is_edge"])
    n_edges = e.select(F.count(F.lit(1))).scalar()
    e_max = e.select(F.max("v")).scalar()
    vals = (ranked.filter(F.col("n_values") > 0)
                  .select("n_values", F.when((F.col("is_edge_cum") == n_edges) & (F.col("v") == e_max), n_edges - 1)
                           .otherwise(F.col("is_edge_cum")).alias("bin")))
    counts = (vals.filter((F.col("bin") >= 1) & (F.col("bin") < n_edges))
                  .groupBy("bin").agg(F.sum("n_values").alias("n")))
    bounds = (ranked.filter(F.col("is_edge") == 1)
                    .select(F.col("is_edge_cum").cast("int").alias("bin"), F.col("v").alias("lower_edge")))
    nxt = bounds.select((F.col("bin") - 1).alias("bin"), F.col("lower_edge").alias("upper_edge"))
    return (bounds.join(nxt, "bin").join(counts, "bin", "left")
                  .select(F.col("bin").cast("int").alias("bin"), "lower_edge", "upper_edge",
                          F.coalesce("n", F.lit(0)).alias("n")))


def repeat_listening(logs: DataFrame, train: DataFrame) -> DataFrame:
    """B16 + B17 + D4 + D16: per-user mean/std of the repeat share, then their mean per class."""
    per_user = (repeat_columns(logs).groupBy("msno").agg(
        F.avg("repeat_percent").alias("mean"), F.stddev_samp("repeat_percent").alias("std")))
    j = per_user.join(train.select("msno", "is_churn"), "msno", "left").filter(F.col("is_churn").isNotNull())
    return j.groupBy("is_churn").agg(F.avg("mean").alias("mean_of_mean"),
                                     F.avg("std").alias("mean_of_std"))


def share_num25_by_class(logs: DataFrame, train: DataFrame) -> DataFrame:
    """B18 + D4 + D16: per-user mean/std of the num_25 share, then mean and std per class.

    (The reference re-aggregates the repeat statistics here by mistake; this
    aggregates the num_25 statistics it just computed.)
    """
    shares = normalised_counters(logs)
    per_user = shares.groupBy("msno").agg(F.avg("num_25").alias("mean"),
                                          F.stddev_samp("num_25").alias("std"))
    j = per_user.join(train.select("msno", "is_churn"), "msno", "left").filter(F.col("is_churn").isNotNull())
    return j.groupBy("is_churn").agg(
        F.avg("mean").alias("mean_of_mean"), F.stddev_samp("mean").alias("std_of_mean"),
        F.avg("std").alias("mean_of_std"), F.stddev_samp("std").alias("std_of_std"))


def calendar_of(logs: DataFrame) -> tuple[_dt.date, int]:
    """First day and number of days of the logs' own calendar (one aggregate; no day without any logs)."""
    first, last = logs.agg(F.min("date"), F.max("date")).first()
    return (first, (last - first).days + 1) if first else (_dt.date(1970, 1, 1), 0)


def calendar_fill(logs: DataFrame, users: DataFrame, first_day: _dt.date, n_days: int,
                  value_col: str = "num_100") -> DataFrame:
    """C7 + B9: every user's value on every day of a fixed calendar, gaps filled with 0.

    The calendar is generated per user row (``explode(sequence)``), not by a
    cross join, then left-joined to the logs on (msno, date).
    """
    if n_days < 1:
        users, n_days = users.limit(0), 1
    last = F.date_add(F.lit(first_day), n_days - 1)
    dense = users.select("msno", F.explode(F.sequence(F.lit(first_day), last)).alias("date"))
    vals = logs.select("msno", "date", F.col(value_col).alias("value"))
    return (dense.join(vals, ["msno", "date"], "left")
                 .select("msno", "date", F.coalesce(F.col("value"), F.lit(0)).cast("double").alias(value_col)))


def logs_right_labels(logs: DataFrame, train: DataFrame, log_users: DataFrame | None = None) -> DataFrame:
    """Every labelled user with their log rows (NULL log columns when none).

    Same rows as ``logs RIGHT JOIN train``, built as an inner join plus the
    labelled users without logs (anti join): AQE can split a hot user's
    partition in an inner join, but not on the outer side of an outer join.
    ``log_users`` gives the users with logs where that is cheaper than ``logs``.
    """
    labels = train.select("msno", "is_churn")
    matched = logs.join(labels, "msno")
    log_cols = [c for c in logs.columns if c != "msno"]
    types = dict(logs.dtypes)
    present = (logs if log_users is None else log_users).select("msno").distinct()
    unmatched = labels.join(present, "msno", "left_anti").select(
        "msno", *[F.lit(None).cast(types[c]).alias(c) for c in log_cols], "is_churn")
    return matched.unionByName(unmatched)

"""Interval join (C8) and the per-transaction feature rows of the first model.

C8: for each transaction, the mean of every usage column over the same
user's log days strictly inside (transaction_date, membership_expire_date).

No log day is paired with a transaction.  A sum over an interval is the
difference of two running sums: up to the last day inside it and up to the
transaction's own day.  They are taken over a user's daily rows (as many as the
calendar has days, at most) and looked up by (user, day), so the joined rows
are two a transaction, however long its interval and however hot its user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.sources.schemas import LOG_METRICS

_FRACTIONS = ("double", "float")


def _counters(logs: DataFrame) -> dict[str, Column]:
    """What is summed for each usage column: its values, how many there are and, where the type has
    them, how many are NaN or infinite.  These stay out of the sum: one of them would spoil every later
    difference."""
    out: dict[str, Column] = {}
    kinds = dict(logs.dtypes)
    for m in LOG_METRICS:
        c = F.col(m)
        if kinds[m] in _FRACTIONS:
            up, down = c == F.lit(float("inf")), c == F.lit(float("-inf"))
            usual = c.isNotNull() & ~F.isnan(c) & ~up & ~down
            out |= {m: F.sum(F.when(usual, c.cast("double")).otherwise(0.0)), f"{m}_nan": F.count_if(F.isnan(c)),
                    f"{m}_up": F.count_if(up), f"{m}_down": F.count_if(down)}
        else:
            out[m] = F.coalesce(F.sum(m), F.lit(0))
        out[f"{m}_n"] = F.count(m)
    return out


def running_sums(logs: DataFrame, points: DataFrame) -> DataFrame:
    """The distinct (msno, date) rows of ``points`` with the sums of all the user's log days up to and with that date.

    The window holds a user's days and points: at most two rows a calendar day, however many log rows or
    transactions the user has.
    """
    counters = _counters(logs)
    daily = logs.groupBy("msno", "date").agg(*[c.alias(n) for n, c in counters.items()])
    nothing = [F.lit(0).cast(daily.schema[n].dataType).alias(n) for n in counters]
    both = (daily.withColumn("_asked", F.lit(False))
                 .unionByName(points.select("msno", "date").distinct().select("*", *nothing, F.lit(True).alias("_asked"))))
    upto = Window.partitionBy("msno").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("msno", "date", "_asked", *[F.sum(n).over(upto).alias(n) for n in counters]) \
               .where("_asked").drop("_asked")


def interval_log_means(tx: DataFrame, logs: DataFrame, tx_key: str = "tx_id", carry: list[str] | None = None) -> DataFrame:
    """One row per transaction: (tx_key, msno, mean of each usage column, ``carry`` columns).

    Both interval ends are open; a transaction without log days inside gets
    NULLs, and so does one whose user or either date is NULL.  A NaN or
    infinite usage value counts in the intervals that hold its day alone.
    Sums of fractions are differences of running sums, hence equal to direct
    ones but for rounding in the last places of the user's total.
    """
    t = tx.select(tx_key, "msno", *(carry or []), F.col("transaction_date").alias("_from"),
                  F.date_sub("membership_expire_date", 1).alias("_to"))
    asked = t.where((F.col("_to") > F.col("_from")) & F.col("msno").isNotNull())
    points = asked.select("msno", F.explode(F.array("_from", "_to")).alias("date"))
    sums = running_sums(logs, points)
    names = [c for c in sums.columns if c not in ("msno", "date")]
    side = sums.select(F.col("msno").alias("_user"), F.col("date").alias("_day"), F.struct(*names).alias("_sums"))

    def look_up(rows: DataFrame, end: str) -> DataFrame:
        met = rows.join(side, (F.col("msno") == F.col("_user")) & (F.col(end) == F.col("_day")), "left")
        return met.withColumnRenamed("_sums", f"_sums{end}").drop("_user", "_day")

    found = look_up(look_up(t, "_from"), "_to")

    def inside(name: str) -> Column:
        return F.col(f"_sums_to.{name}") - F.col(f"_sums_from.{name}")

    kinds = dict(logs.dtypes)
    means = []
    for m in LOG_METRICS:
        mean = F.try_divide(inside(m), inside(f"{m}_n"))
        if kinds[m] in _FRACTIONS:
            nan, up, down = (inside(f"{m}_{k}") > 0 for k in ("nan", "up", "down"))
            mean = (F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf")))
                     .when(down, F.lit(float("-inf"))).otherwise(mean))
        filled = (F.col("_to") > F.col("_from")) & (inside(f"{m}_n") > 0)
        means.append(F.when(filled, mean).alias(m))
    return found.select(tx_key, "msno", *means, *(carry or []))


def first_model_rows(tx: DataFrame, logs: DataFrame, tx_key: str = "tx_id",
                     carry: list[str] | None = None) -> DataFrame:
    """J5 + B11: C8 means per transaction with the transaction's own columns
    (``carry``, e.g. ``is_cancel``) beside them, rows with any NULL dropped."""
    return interval_log_means(tx, logs, tx_key, carry=carry).dropna(how="any")

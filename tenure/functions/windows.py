"""Ordered helpers that never put a whole (possibly hot) key in one task.

``day_bucket`` gives the time bucket used to split a key's ordered rows
over several windows (see ``operators.transactions``).

``prefix_sums`` is a global running sum over a sorted column without
``Window.orderBy`` on the whole table.  Rows are cut into ranges of the first
order column; each range is summed on its own and shifted by the totals of the
ranges before it.  A row's range is a pure function of its value (the number
of split points at or below it, the split points being literals of the plan),
so every branch of the plan, every retry and every partition count agrees on it.

``next_values`` looks one row ahead in the same way: inside the range, and for
a range's last row at the first row of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 32


def day_bucket(c: Column | str, bucket_days: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_date(c) / F.lit(bucket_days)).cast("long")


def split_points(df: DataFrame, col: str, num_ranges: int) -> list:
    """At most ``num_ranges`` - 1 ascending values that cut ``col``'s distinct values about evenly.

    They come from a bounded sample: the ``SAMPLES_PER_RANGE`` x ranges distinct
    values of smallest hash.  A poor sample only makes ranges uneven.
    """
    c = F.col(col)
    sample = (df.select(c).where(c.isNotNull()).distinct().orderBy(F.xxhash64(c))
                .limit(SAMPLES_PER_RANGE * num_ranges).orderBy(c))
    values = [r[0] for r in sample.collect()]
    picks = [values[k * len(values) // num_ranges] for k in range(1, num_ranges)] if values else []
    return [v for k, v in enumerate(picks) if k == 0 or v != picks[k - 1]]


def range_id(c: Column, points: list) -> Column:
    """How many of the ascending ``points`` are at or below the value, found by halving; NULL is below all."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))
    return F.when(c.isNull(), F.lit(0)).otherwise(search(0, len(points)))


def prefix_sums(df: DataFrame, order_cols: list[str] | str, sum_cols: list[str],
                group_cols: list[str] | None = None, num_ranges: int | None = None,
                suffix: str = "_cum") -> DataFrame:
    """Running sums of ``sum_cols`` in ascending ``order_cols`` order (row included),
    restarted for each ``group_cols`` value.

    Rows tied on every order column get different running values; callers
    either pre-aggregate to unique keys or only read sums that ties cannot
    change.  Ranges are cut on the first order column, so a value of it that
    many rows share is one range: callers pre-aggregate.  The totals have a
    row per (group, range); how they are joined is left to AQE.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    group_cols = list(group_cols or [])
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_range_id", range_id(F.col(order_cols[0]), split_points(df, order_cols[0], n)))
    totals = ranged.groupBy(*group_cols, "_range_id").agg(
        *[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    wt = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_range_id") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g_{g}") for g in group_cols], F.col("_range_id").alias("_r"), *[
        F.coalesce(F.sum(f"_tot_{c}").over(wt), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    wi = Window.partitionBy(*group_cols, "_range_id").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = ranged.select("*", *[F.sum(c).over(wi).alias(f"{c}{suffix}") for c in sum_cols])
    on = F.col("_range_id") == F.col("_r")
    for g in group_cols:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = inner.join(offsets, on)
    for c in sum_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}") + F.col(f"_off_{c}"))
    return out.drop("_range_id", "_r", *[f"_g_{g}" for g in group_cols], *[f"_off_{c}" for c in sum_cols])


def next_values(df: DataFrame, order_col: str, value_cols: list[str], group_cols: list[str] | None = None,
                num_ranges: int | None = None, prefix: str = "next_") -> DataFrame:
    """``value_cols`` of the next row in ascending ``order_col`` within each ``group_cols`` value, as
    ``next_...``; NULL on a group's last row.  ``order_col`` is unique within a group.
    """
    group_cols = list(group_cols or [])
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_range_id", range_id(F.col(order_col), split_points(df, order_col, n)))
    row = F.struct(*value_cols)
    firsts = ranged.groupBy(*group_cols, "_range_id").agg(F.min_by(row, F.col(order_col)).alias("_first"))
    wr = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_range_id")     # a row a range
    following = firsts.select(*[F.col(g).alias(f"_g_{g}") for g in group_cols], F.col("_range_id").alias("_r"),
                              F.lead("_first").over(wr).alias("_following"))
    on = F.col("_range_id") == F.col("_r")
    for g in group_cols:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    ahead = ranged.withColumn("_next", F.lead(row).over(Window.partitionBy(*group_cols, "_range_id").orderBy(order_col)))
    out = ahead.join(following, on).withColumn("_next", F.coalesce("_next", "_following"))
    return out.select(*df.columns, *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in value_cols])

"""Member-side operators (B7-B9, B20, J2) and table profiles."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.dates import days_until, ymd_int_to_date

# Fixed values of the member cleaning rules (reference behaviour).
AGE_MIN, AGE_MAX, AGE_FILL = 1, 90, 26
GENDER_FILL = "Not_given"

SKETCH_LG_K = 14         # registers of a distinct sketch, as a power of two: 0.65 % standard error


def clean_age(c: str = "bd") -> F.Column:
    """Ages above 90 or below 1 are replaced by 26."""
    return F.when((F.col(c) > AGE_MAX) | (F.col(c) < AGE_MIN), F.lit(AGE_FILL)).otherwise(F.col(c))


def member_clean(members: DataFrame, last_day: _dt.date) -> DataFrame:
    """Cleaned member attributes plus days registered up to ``last_day``."""
    reg = ymd_int_to_date("registration_init_time")
    return members.select(
        "msno", "city",
        clean_age("bd").alias("bd"),
        F.coalesce(F.col("gender"), F.lit(GENDER_FILL)).alias("gender"),
        "registered_via",
        reg.alias("registration_date"),
        days_until(last_day, reg).alias("associated_time"),
    )


def column_distinct_profile(df: DataFrame) -> DataFrame:
    """Number of distinct values per column, NULL counted as one value.

    One aggregation pass over the table, then an unpivot to (column, n).
    """
    cols = df.columns
    aggs = []
    for c in cols:
        aggs.append((F.count_distinct(F.col(c))
                     + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).cast("long").alias(c))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, n_distinct)")


def column_distinct_sketch(df: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """D11 by sketches: about how many distinct values a column holds, NULL counted as one value.

    One row per column: (column_name, n_distinct).  Every column has one HyperLogLog sketch of at most
    2^``lg_k`` registers; sketches merge, so that no row is copied per column and no value is shuffled.
    The relative standard error is about 0.83 / 2^(``lg_k`` / 2), 0.65 % at 14; few values are counted exactly.
    """
    sketched = ("int", "bigint", "string", "binary")       # other types by their text
    wide = df.agg(*[
        (F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c) if t in sketched else F.col(c).cast("string"), lg_k))
         + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).cast("long").alias(c)
        for c, t in df.dtypes])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, n_distinct)")


def object_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count / unique / top / freq of text columns (NULLs not counted).

    Two-level: value counts per (column, value), then one row per column;
    ties for ``top`` go to the smallest value.  Nothing is collected.
    """
    longs = None
    for c in columns:
        part = df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        longs = part if longs is None else longs.unionByName(part)
    vc = (longs.filter(F.col("value").isNotNull())
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq")))
    return vc.groupBy("column_name").agg(
        F.sum("freq").cast("long").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("freq"), F.col("value"))).alias("top"),
        F.max("freq").alias("freq"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value (NULL kept as its own value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))

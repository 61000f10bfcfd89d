"""User universe: common users (H1, D10, D18) and semi-join reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_users(df: DataFrame, key: str = "msno") -> DataFrame:
    """D10."""
    return df.select(key).distinct()


def common_users(*tables: DataFrame, key: str = "msno") -> DataFrame:
    """H1: users present in every table (chained INTERSECT, each side de-duplicated)."""
    out = distinct_users(tables[0], key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out


def keep_users(df: DataFrame, users: DataFrame, key: str = "msno") -> DataFrame:
    """Rows whose user is in ``users`` (LEFT SEMI; AQE broadcasts a small id set)."""
    return df.join(users, key, "left_semi")


def table_row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for a few tables, one aggregation each, unioned."""
    out = None
    for name, df in named.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def user_rows(df: DataFrame, user, order_cols: list[str], n: int | None = None,
              key: str = "msno") -> DataFrame:
    """B5 + G1 + G3: one user's rows in order, optionally the first ``n``.

    The equality filter on the key reaches the parquet scan (row-group
    statistics skip data when files are clustered by user).
    """
    out = df.filter(F.col(key) == F.lit(user)).orderBy(*order_cols)
    return out.limit(n) if n is not None else out

"""Registry of named queries: name -> (spark builder, oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
given tables.  Doubles in reported results are rounded to 6 places (on both
the Spark and the oracle side) so that results compare by hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (top level) for hash-stable comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None, ops: str = "", rounded: bool = True):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        build = (lambda spark, sf_dir: report(fn(spark, sf_dir))) if rounded else fn
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from tenure.plans import (  # noqa: F401
        q_transactions, q_members, q_logs, q_features, q_eda, q_intervals, q_sampling,
        q_metrics, q_encode, q_models, q_timeseries, q_streaming)
    return REGISTRY

"""Binning (F1-F3, F6) as column expressions.

Equal-width bins need the observed min and max; they enter the plan as
scalar subqueries (one merged aggregate), never as a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width_bin(df: DataFrame, col: str, n_bins: int) -> tuple[Column, Column, Column]:
    """pandas ``cut(x, bins=n)`` ordinal (1..n), right-closed, min in bin 1.

    Returns (bin, lower_edge, upper_edge).  Width w = (max-min)/n; bin k covers
    (min+(k-1)w, min+kw].  If every value is equal, pandas widens the range by
    0.1 % on each side and the value lands in the middle bin.
    """
    mn = df.select(F.min(F.col(col).cast("double"))).scalar()
    mx = df.select(F.max(F.col(col).cast("double"))).scalar()
    w = (mx - mn) / F.lit(float(n_bins))
    x = F.col(col).cast("double")
    raw = F.ceil((x - mn) / w).cast("int")
    b = (F.when(w == 0, F.lit((n_bins + 1) // 2))
          .otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(n_bins))))
    lo = mn + (b - 1) * w
    hi = mn + b * w
    return b, lo, hi


def explicit_bin(col: str | Column, edges: list[float]) -> Column:
    """right-closed bins over explicit edges; bin k = (edges[k-1], edges[k]]; outside -> NULL.

    (MLlib's Bucketizer is left-closed, so it is not used.)
    """
    x = F.col(col) if isinstance(col, str) else col
    expr = None
    for k in range(1, len(edges)):
        cond = (x > F.lit(edges[k - 1])) & (x <= F.lit(edges[k]))
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr


def interval_labels(edges: list[float]) -> list[str]:
    """pandas-style labels of right-closed intervals, e.g. ``(0, 12]``."""
    def fmt(v):
        return str(int(v)) if float(v).is_integer() else str(v)
    return [f"({fmt(edges[k - 1])}, {fmt(edges[k])}]" for k in range(1, len(edges))]


def label_of(bin_col: Column | str, labels: list[str]) -> Column:
    """label of a 1-based bin ordinal."""
    b = F.col(bin_col) if isinstance(bin_col, str) else bin_col
    return F.element_at(F.array(*[F.lit(s) for s in labels]), b)


def bin_spine(df: DataFrame, n_bins: int) -> DataFrame:
    """Bin ordinals 1..n (for showing empty bins)."""
    return df.sparkSession.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))

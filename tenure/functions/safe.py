"""Arithmetic that keeps ANSI mode quiet and outputs hash-comparable.

pandas silently turns x/0 into inf or NaN; Spark 4 (ANSI) raises.  Ratios use
``try_divide`` and become NULL.  Z-scores keep the reference's pandas meaning
(inf / NaN cases) but are imputed the way the reference's model prep does it
(null/NaN -> 0, +-inf -> a constant) with a status column telling which case
happened, so no NaN or inf ever reaches an output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def pandas_z(diff: Column, std: Column, inf_value: float) -> Column:
    """(mean_cur - mean_hist) / std_hist with pandas' outcome, already imputed.

    std NULL (one historical row) -> NaN in pandas -> imputed 0.
    std 0, diff 0 -> NaN -> 0.  std 0, diff != 0 -> +-inf -> ``inf_value``.
    """
    return (F.when(std.isNull() | diff.isNull(), F.lit(0.0))
             .when(std == 0, F.when(diff == 0, F.lit(0.0)).otherwise(F.lit(float(inf_value))))
             .otherwise(diff / std))

"""Date helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ymd_int_to_date(c: Column | str, strict: bool = False) -> Column:
    """Integer ``yyyymmdd`` -> DATE.  Dirty values become NULL unless ``strict``."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.to_date(text, "yyyyMMdd") if strict else F.try_to_date(text, "yyyyMMdd")


def as_date_lit(d: str | _dt.date) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def days_until(end: str | _dt.date, c: Column | str) -> Column:
    """Whole days from ``c`` to the fixed day ``end`` (B20: associated_time, days since login)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.datediff(as_date_lit(end), c)

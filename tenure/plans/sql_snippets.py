"""Reusable DuckDB SQL fragments for the oracle (same meaning as the Spark code)."""

from __future__ import annotations

from tenure.operators.logs import METRIC_SUFFIX
from tenure.sources.schemas import LOG_METRICS


def z_aggs_sql(tag: str, cur: str, hist: str) -> str:
    parts = [f"count(*) FILTER (WHERE {cur}) AS {tag}_ncur",
             f"count(*) FILTER (WHERE {hist}) AS {tag}_nhist"]
    for m in LOG_METRICS:
        x = f"CAST({m} AS DOUBLE)"
        parts += [f"avg(CASE WHEN {cur} THEN {x} END) AS {tag}_cur_{m}",
                  f"avg(CASE WHEN {hist} THEN {x} END) AS {tag}_hist_{m}",
                  f"stddev_samp(CASE WHEN {hist} THEN {x} END) AS {tag}_std_{m}"]
    return ",\n       ".join(parts)


def z_expr_sql(tag: str, m: str, inf_value: float) -> str:
    diff = f"({tag}_cur_{m} - {tag}_hist_{m})"
    s = f"{tag}_std_{m}"
    return (f"CASE WHEN {s} IS NULL OR {diff} IS NULL THEN 0.0 "
            f"WHEN {s} = 0 THEN (CASE WHEN {diff} = 0 THEN 0.0 ELSE {float(inf_value)} END) "
            f"ELSE {diff} / {s} END")


def _std_zero_sql(tag: str) -> str:
    return "(" + " OR ".join(f"coalesce({tag}_std_{m} = 0, FALSE)" for m in LOG_METRICS) + ")"


def z_boundary_cols_sql(tag: str, inf_value: float = 5.0, names: str = "z_{s}",
                        status: bool = True) -> str:
    ncur, nhist = f"coalesce({tag}_ncur, 0)", f"coalesce({tag}_nhist, 0)"
    cols = [f"round(CASE WHEN {ncur} = 0 THEN 5.0 WHEN {nhist} = 0 THEN 1.0 "
            f"ELSE {z_expr_sql(tag, m, inf_value)} END, 6) AS {names.format(s=METRIC_SUFFIX[m])}"
            for m in LOG_METRICS]
    if status:
        cols.append(f"CASE WHEN {ncur} = 0 THEN 'cur_empty' WHEN {nhist} = 0 THEN 'hist_empty' "
                    f"WHEN {nhist} = 1 THEN 'std_null' WHEN {_std_zero_sql(tag)} THEN 'std_zero' ELSE 'ok' END AS status")
    return ",\n  ".join(cols)


def z_trailing_cols_sql(tag: str, suffix: str, inf_value: float = 5.0, status: bool = True) -> str:
    ncur, nhist = f"coalesce({tag}_ncur, 0)", f"coalesce({tag}_nhist, 0)"
    cols = []
    for m in LOG_METRICS:
        he = "1.0" if m == "total_secs" else "5.0"
        cols.append(f"round(CASE WHEN {nhist} = 0 THEN {he} WHEN {ncur} = 0 THEN 3.0 "
                    f"ELSE {z_expr_sql(tag, m, inf_value)} END, 6) AS z_{METRIC_SUFFIX[m]}_{suffix}")
    if status:
        cols.append(f"CASE WHEN {nhist} = 0 THEN 'hist_empty' WHEN {ncur} = 0 THEN 'cur_empty' "
                    f"WHEN {nhist} = 1 THEN 'std_null' WHEN {_std_zero_sql(tag)} THEN 'std_zero' ELSE 'ok' END AS status")
    return ",\n  ".join(cols)


def trailing_conds_sql(last_day: str, h: int, c: int) -> tuple[str, str]:
    end = f"DATE '{last_day}'"
    hist = f"(date >= {end} - INTERVAL {h} DAY AND date <= {end})"
    cur = f"(date >= {end} - INTERVAL {c} DAY AND date <= {end})"
    return cur, hist


def login_rate_aggs_sql(pairs) -> str:
    parts = []
    for h, c, sfx in pairs:
        parts += [f"count(*) FILTER (WHERE date >= last_login_date - INTERVAL {h} DAY "
                  f"AND date <= last_login_date) AS _lh_{sfx}",
                  f"count(*) FILTER (WHERE date >= last_login_date - INTERVAL {c} DAY "
                  f"AND date <= last_login_date) AS _lc_{sfx}"]
    return ",\n       ".join(parts)


def login_rate_cols_sql(pairs) -> str:
    return ",\n  ".join(f"round(_lh_{sfx} / {float(h)} - _lc_{sfx} / {float(c)}, 6) AS login_diff_{sfx}"
                        for h, c, sfx in pairs)

"""Registered time-series queries (E8, E9) on every user's daily series.

The calendar is the logs' own (first to last day of the data).  It is too short
for the reference's period 30, so periods 7 and 6 (odd and even trend filters)
run on the users' usage, and period 30 on the daily transaction counts of each
payment method, whose calendar spans years.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import eda as D
from tenure.operators import timeseries as TS
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import Tables


def _series_sql(rows: str) -> tuple[str, str]:
    """The dense daily series ``ds`` of a view (msno, date, num_25)."""
    return ("ds", f"""SELECT u.msno, d.date, CAST(coalesce(l.num_25, 0) AS DOUBLE) AS x,
       CAST(date_diff('day', (SELECT min(date) FROM {rows}), d.date) AS INT) AS t
       FROM (SELECT DISTINCT msno FROM {rows}) u
       CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM {rows}),
                   (SELECT max(date) FROM {rows}), INTERVAL 1 DAY)) AS DATE) AS date) d
       LEFT JOIN {rows} l ON l.msno = u.msno AND l.date = d.date""")


_DS = _series_sql("user_logs")


def _series(spark, sf_dir):
    logs = Tables(spark, sf_dir).user_logs
    return TS.daily_series(logs, *D.calendar_of(logs))


_METHOD_DAYS = ("md", """SELECT CAST(payment_method_id AS BIGINT) AS msno, transaction_date AS date,
       count(*) AS num_25 FROM tx GROUP BY 1, 2""")


def _method_series(spark, sf_dir):
    days = Tables(spark, sf_dir).tx.groupBy(
        F.col("payment_method_id").cast("long").alias("msno"), F.col("transaction_date").alias("date")).agg(
        F.count(F.lit(1)).alias("num_25"))
    return TS.daily_series(days, *D.calendar_of(days))


def _decompose_sql(m: int, views: tuple = ("user_logs",), ctes: tuple = (_DS,)) -> str:
    h = m // 2
    frame = f"sum(x) OVER (PARTITION BY msno ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    if m % 2 == 0:
        ends = (f"(lag(x, {h}) OVER (PARTITION BY msno ORDER BY t) "
                f"+ lead(x, {h}) OVER (PARTITION BY msno ORDER BY t))")
        trend = f"({frame} - 0.5 * {ends}) / {float(m)}"
    else:
        trend = f"{frame} / {float(m)}"
    return with_views(f"""
SELECT tr.msno, tr.date, tr.t, round(tr.x, 6) AS observed, round(tr.trend, 6) AS trend,
       round(se.seasonal, 6) AS seasonal, round(tr.x - tr.trend - se.seasonal, 6) AS resid
FROM tr JOIN se ON tr.msno = se.msno AND tr.phase = se.phase""", *views, extra=[
        *ctes,
        ("tr", f"""SELECT msno, date, t, x, t % {m} AS phase,
       CASE WHEN t >= {h} AND t <= max(t) OVER (PARTITION BY msno) - {h} THEN {trend} END AS trend
       FROM ds"""),
        ("pm", "SELECT msno, phase, avg(x - trend) AS pm FROM tr GROUP BY msno, phase"),
        ("se", "SELECT msno, phase, pm - avg(pm) OVER (PARTITION BY msno) AS seasonal FROM pm"),
    ])


def _decompose_query(m: int):
    def build(spark, sf_dir):
        return TS.seasonal_decompose(_series(spark, sf_dir), m)
    return build


for _m in (7, 6):
    register(f"seasonal_decompose_{_m}", _decompose_sql(_m), "E8")(_decompose_query(_m))


@register("seasonal_decompose_30", _decompose_sql(30, ("tx",), (_METHOD_DAYS, _series_sql("md"))), "E8 (period 30)")
def q_seasonal_decompose_30(spark, sf_dir):
    return TS.seasonal_decompose(_method_series(spark, sf_dir), 30)


def _crit_sql(level: str) -> str:
    b = TS.ADF_CRIT_CONSTANT[level]
    n = "CAST(nobs AS DOUBLE)"
    return (f"round({b[0]} + {b[1]} / {n} + {b[2]} / ({n} * {n}) + {b[3]} / ({n} * {n} * {n}), 6) "
            f"AS crit_{level.rstrip('%')}")


@register("unit_root_lag0", with_views(f"""
SELECT msno, nobs, round(CASE WHEN ok THEN sxy / sxx END, 6) AS slope,
       round(CASE WHEN ok AND se > 0 THEN (sxy / sxx) / se END, 6) AS adf_stat,
       {', '.join(_crit_sql(k) for k in TS.ADF_CRIT_CONSTANT)}
FROM (SELECT *, n >= 3 AND sxx > 0 AS ok,
             sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0.0) / (n - 2) / nullif(sxx, 0)) AS se,
             CAST(n AS BIGINT) AS nobs
      FROM (SELECT msno, regr_count(x - xl, xl) AS n, regr_sxx(x - xl, xl) AS sxx,
                   regr_syy(x - xl, xl) AS syy, regr_sxy(x - xl, xl) AS sxy
            FROM (SELECT msno, t, x, lag(x) OVER (PARTITION BY msno ORDER BY t) AS xl FROM ds) d
            WHERE xl IS NOT NULL GROUP BY msno) g) q""", "user_logs", extra=[_DS]), "E9 (lag 0)")
def q_unit_root_lag0(spark, sf_dir):
    return TS.unit_root_lag0(_series(spark, sf_dir))


SQL_LAGS = 13      # steps written out in the oracle: enough for a calendar of up to 137 days
_LEVEL, _STEP = 998, 999        # column numbers of the level and the step; 1, 2, ... are the lagged steps


def _products_sql(source: str) -> str:
    """Centred cross-products (a, b, v) of a long table (msno, t, c, v), with ``d``, column a's own."""
    return f"""SELECT *, max(CASE WHEN a = b THEN v END) OVER (PARTITION BY msno, a) AS d
       FROM (SELECT l.msno, l.c AS a, r.c AS b, count(*) AS m, sum(l.v * r.v) - sum(l.v) * sum(r.v) / count(*) AS v
             FROM {source} l JOIN {source} r ON l.msno = r.msno AND l.t = r.t GROUP BY l.msno, l.c, r.c) q"""


def _without_sql(source: str, k: int, taken: str) -> str:
    """``source`` after regressing every column on column ``k``.  Users whose column k the others explain
    drop out; those without a column k stay as they are."""
    return f"""SELECT e.msno, e.a, e.b, e.m, e.d, e.v - coalesce(r.v * c.v / p.v, 0) AS v FROM {source} e
       LEFT JOIN {source} p ON p.msno = e.msno AND p.a = {k} AND p.b = {k}
       LEFT JOIN {source} r ON r.msno = e.msno AND r.a = e.a AND r.b = {k}
       LEFT JOIN {source} c ON c.msno = e.msno AND c.a = {k} AND c.b = e.b
       WHERE e.a {taken} AND e.b {taken} AND coalesce(p.v > {TS.RANK_TOL} * p.d, true)"""


def _adf_sql() -> str:
    steps = [_LEVEL, *range(1, SQL_LAGS + 1)]
    ctes = [
        ("dd", """SELECT msno, t, x - lag(x) OVER w AS dx, lag(x) OVER w AS xl,
       greatest(0, least(CAST(ceil(12 * pow(count(*) OVER (PARTITION BY msno) / 100.0, 0.25)) AS INT),
                         CAST(count(*) OVER (PARTITION BY msno) // 2 - 2 AS INT))) AS lim
       FROM ds WINDOW w AS (PARTITION BY msno ORDER BY t)"""),
        ("lo", f"""SELECT msno, t, lim, {_LEVEL} AS c, xl AS v FROM dd WHERE t > 0
       UNION ALL SELECT msno, t, lim, {_STEP}, dx FROM dd WHERE t > 0
       UNION ALL SELECT a.msno, a.t, a.lim, a.t - b.t, b.dx FROM dd a JOIN dd b
         ON a.msno = b.msno AND b.t < a.t AND b.t >= a.t - a.lim AND b.t > 0"""),
        ("common", "SELECT * FROM lo WHERE t > lim"),
        ("a0", _products_sql("common"))]
    for i, k in enumerate(steps):       # the level first, then one lagged step after the other
        ctes.append((f"a{i + 1}", _without_sql(f"a{i}", k, "<> " + str(k)) + f"""
       AND EXISTS (SELECT 1 FROM a{i} h WHERE h.msno = e.msno AND h.a = {k})"""))
    tried = " UNION ALL ".join(
        f"""SELECT msno, {i} AS lag, CASE WHEN v > {TS.RANK_TOL} * d THEN m * ln(v) + {2 * i}
       ELSE CAST('-infinity' AS DOUBLE) END AS aic FROM a{i + 1} WHERE a = {_STEP} AND b = {_STEP}"""
        for i in range(len(steps)))
    ctes += [
        ("tried", tried),
        ("chosen", """SELECT u.msno, coalesce(k.lag, 0) AS lag, u.n FROM (SELECT msno, count(*) AS n FROM ds GROUP BY msno) u
       LEFT JOIN (SELECT msno, lag FROM tried QUALIFY row_number() OVER (PARTITION BY msno ORDER BY aic, lag) = 1) k
         ON k.msno = u.msno"""),
        ("own", """SELECT lo.msno, lo.t, lo.c, lo.v FROM lo JOIN chosen ON chosen.msno = lo.msno
       WHERE lo.t > chosen.lag AND (lo.c <= chosen.lag OR lo.c >= """ + f"{_LEVEL})"),
        ("b0", _products_sql("own"))]
    for k in range(1, SQL_LAGS + 1):
        ctes.append((f"b{k}", _without_sql(f"b{k - 1}", k, f"<> {k}")))
    last = f"b{SQL_LAGS}"
    return with_views(f"""
SELECT c.msno, c.lag AS used_lag, CAST(c.n - 1 - c.lag AS INT) AS nobs,
       round(CASE WHEN z.v > {TS.RANK_TOL} * z.d AND z.m > c.lag + 2 AND y.v - zy.v * zy.v / z.v > {TS.RANK_TOL} * y.d
                  THEN zy.v / sqrt((y.v - zy.v * zy.v / z.v) / (z.m - c.lag - 2) * z.v) END, 6) AS adf_stat,
       {', '.join(_crit_sql(k) for k in TS.ADF_CRIT_CONSTANT)}
FROM chosen c LEFT JOIN {last} z ON z.msno = c.msno AND z.a = {_LEVEL} AND z.b = {_LEVEL}
LEFT JOIN {last} zy ON zy.msno = c.msno AND zy.a = {_LEVEL} AND zy.b = {_STEP}
LEFT JOIN {last} y ON y.msno = c.msno AND y.a = {_STEP} AND y.b = {_STEP}""", "user_logs", extra=[_DS, *ctes]).replace(
        "AS (SELECT", "AS MATERIALIZED (SELECT")


@register("unit_root_adf", _adf_sql(), "E9 (lag by AIC)")
def q_unit_root_adf(spark, sf_dir):
    logs = Tables(spark, sf_dir).user_logs
    first_day, days = D.calendar_of(logs)
    return TS.unit_root_adf(TS.daily_series(logs, first_day, days), days=days)


@register("unit_root_p_values", None, "E9 (p-values by simulation)")
def q_unit_root_p_values(spark, sf_dir):
    return TS.with_p_values(TS.unit_root_lag0(_series(spark, sf_dir)).select("msno", "nobs", "adf_stat"))

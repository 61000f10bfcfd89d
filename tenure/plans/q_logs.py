"""Registered usage-log queries."""

from __future__ import annotations

from tenure.operators import logs as L
from tenure.operators import transactions as X
from tenure.plans import sql_snippets as S
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import LOG_LAST_DAY, Tables
from tenure.sources.schemas import LOG_METRICS

_AVG_SQL = ", ".join(f"avg({m}) AS avg_{L.METRIC_SUFFIX[m]}" for m in LOG_METRICS)


@register("log_averages", with_views(f"""
SELECT msno, {', '.join(f'round(avg({m}), 6) AS avg_{L.METRIC_SUFFIX[m]}' for m in LOG_METRICS)}
FROM user_logs GROUP BY msno""", "user_logs"), "D3")
def q_log_averages(spark, sf_dir):
    return L.log_averages(Tables(spark, sf_dir).user_logs)


@register("last_login", with_views(f"""
SELECT msno, max(date) AS last_login_date,
       CAST(date_diff('day', max(date), DATE '{LOG_LAST_DAY}') AS INT) AS days_since_last_login
FROM user_logs GROUP BY msno""", "user_logs"), "D5 B20")
def q_last_login(spark, sf_dir):
    return L.last_login(Tables(spark, sf_dir).user_logs, LOG_LAST_DAY)


_BOUNDS_CTE = ("b", """SELECT msno, min(transaction_date) AS first_transaction_date,
       max(transaction_date) AS last_transaction_date FROM tx_ev GROUP BY msno""")


def _z_boundary_sql(lower_bound: bool, inf_value: float) -> str:
    cur = "date > last_transaction_date"
    hist = "date <= last_transaction_date"
    if lower_bound:
        hist = f"({hist} AND date >= first_transaction_date)"
    return with_views(f"""
SELECT b.msno,
  {S.z_boundary_cols_sql('zb', inf_value)}
FROM b LEFT JOIN a ON a.msno = b.msno""", "tx_ev", "user_logs", extra=[
        _BOUNDS_CTE,
        ("a", f"""SELECT user_logs.msno, {S.z_aggs_sql('zb', cur, hist)}
       FROM user_logs JOIN b ON user_logs.msno = b.msno GROUP BY user_logs.msno""")])


@register("z_boundary", _z_boundary_sql(True, L.INF_FILL_FINAL), "E4 E7 C9")
def q_z_boundary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return L.z_boundary(X.tx_bounds(t.tx_ev), t.user_logs, True, L.INF_FILL_FINAL)


@register("z_boundary_open", _z_boundary_sql(False, L.INF_FILL_EARLY), "E4 (no lower bound)")
def q_z_boundary_open(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return L.z_boundary(X.tx_bounds(t.tx_ev), t.user_logs, False, L.INF_FILL_EARLY)


def _z_trailing_sql(h: int, c: int, sfx: str) -> str:
    cur, hist = S.trailing_conds_sql(str(LOG_LAST_DAY), h, c)
    return with_views(f"""
SELECT m.msno,
  {S.z_trailing_cols_sql('zt', sfx)}
FROM members m LEFT JOIN a ON a.msno = m.msno""", "members", "user_logs", extra=[
        ("a", f"""SELECT msno, {S.z_aggs_sql('zt', cur, 'TRUE')}
       FROM user_logs WHERE {hist} GROUP BY msno""")])


def _z_trailing_query(h: int, c: int, sfx: str):
    def build(spark, sf_dir):
        t = Tables(spark, sf_dir)
        return L.z_trailing(t.members, t.user_logs, LOG_LAST_DAY, h, c, sfx)
    return build


for _h, _c, _sfx in [(30, 14, "3014"), (15, 7, "147"), (5, 1, "51")]:
    register(f"z_trailing_{_h}_{_c}", _z_trailing_sql(_h, _c, _sfx), "E5")(
        _z_trailing_query(_h, _c, _sfx))


@register("login_diff", with_views(f"""
SELECT msno, {S.login_rate_cols_sql(L.E6_PAIRS)}
FROM (SELECT user_logs.msno, {S.login_rate_aggs_sql(L.E6_PAIRS)}
      FROM user_logs JOIN e ON user_logs.msno = e.msno GROUP BY user_logs.msno) s""",
    "user_logs", extra=[("e", "SELECT msno, max(date) AS last_login_date FROM user_logs GROUP BY msno")]),
    "E6")
def q_login_diff(spark, sf_dir):
    return L.login_diff(Tables(spark, sf_dir).user_logs)


@register("listen_ratios", with_views("""
SELECT msno, date,
       round(CASE WHEN num_100 = 0 THEN NULL ELSE CAST(num_25 AS DOUBLE) / num_100 END, 6) AS ratio_25_100,
       round(CASE WHEN num_100 = 0 THEN NULL ELSE CAST(num_50 AS DOUBLE) / num_100 END, 6) AS ratio_50_100
FROM user_logs""", "user_logs"), "B15")
def q_listen_ratios(spark, sf_dir):
    return L.listen_ratios(Tables(spark, sf_dir).user_logs)


@register("song_length", with_views("""
SELECT msno, date,
       round(total_secs / nullif(0.25 * num_25 + 0.5 * num_50 + 0.75 * num_75 + 0.985 * num_985
                                 + 1.0 * num_100, 0), 6) AS song_length
FROM user_logs""", "user_logs"), "B19")
def q_song_length(spark, sf_dir):
    return L.song_length(Tables(spark, sf_dir).user_logs)


@register("normalised_counters", with_views("""
SELECT msno, date, round(num_25 / nullif(t, 0), 6) AS num_25, round(num_50 / nullif(t, 0), 6) AS num_50,
       round(num_75 / nullif(t, 0), 6) AS num_75, round(num_985 / nullif(t, 0), 6) AS num_985,
       round(num_100 / nullif(t, 0), 6) AS num_100
FROM (SELECT *, CAST(coalesce(num_25, 0) + coalesce(num_50, 0) + coalesce(num_75, 0)
                     + coalesce(num_985, 0) + coalesce(num_100, 0) AS DOUBLE) AS t FROM user_logs) s""",
    "user_logs"), "B16 B18")
def q_normalised_counters(spark, sf_dir):
    return L.normalised_counters(Tables(spark, sf_dir).user_logs)

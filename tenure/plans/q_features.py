"""Registered flagship: the per-user feature table."""

from __future__ import annotations

from tenure.operators import features as FT
from tenure.operators import logs as L
from tenure.plans import sql_snippets as S
from tenure.plans.oracle_views import with_views
from tenure.plans.q_members import COMMON_USERS_SQL, MEMBER_CLEAN_SQL
from tenure.plans.q_transactions import TX_PROFILE_CTES, TX_PROFILE_SELECT
from tenure.plans.registry import register
from tenure.sources.fixtures import LOG_LAST_DAY, MEMBER_LAST_DAY, Tables
from tenure.sources.schemas import LOG_METRICS


def _p1_sql() -> str:
    aggs = [f"avg({m}) AS avg_{L.METRIC_SUFFIX[m]}" for m in LOG_METRICS]
    aggs.append("max(date) AS last_login_date")
    for h, c, sfx in L.E5_PAIRS:
        cur, hist = S.trailing_conds_sql(str(LOG_LAST_DAY), h, c)
        aggs.append(S.z_aggs_sql(f"zt{sfx}", cur, hist))
    return f"SELECT msno, {', '.join(aggs)} FROM user_logs GROUP BY msno"


def _p2_sql() -> str:
    cur = "date > last_transaction_date"
    hist = "(date <= last_transaction_date AND date >= first_transaction_date)"
    return f"""SELECT user_logs.msno, {S.z_aggs_sql('zb', cur, hist)},
       {S.login_rate_aggs_sql(L.E6_PAIRS)}
       FROM user_logs JOIN an ON user_logs.msno = an.msno GROUP BY user_logs.msno"""


def _j3_select() -> str:
    cols = [f"round(avg_{L.METRIC_SUFFIX[m]}, 6) AS avg_{L.METRIC_SUFFIX[m]}" for m in LOG_METRICS]
    cols.append(f"CAST(date_diff('day', last_login_date, DATE '{LOG_LAST_DAY}') AS INT) "
                "AS days_since_last_login")
    cols.append(S.z_boundary_cols_sql("zb", status=False))
    for h, c, sfx in L.E5_PAIRS:
        cols.append(S.z_trailing_cols_sql(f"zt{sfx}", sfx, status=False))
    cols.append(S.login_rate_cols_sql(L.E6_PAIRS))
    return f"SELECT p1.msno, {', '.join(cols)} FROM p1 JOIN p2 ON p1.msno = p2.msno"


FEATURE_TABLE_SQL = with_views(f"""
SELECT {', '.join(FT.feature_columns())}
FROM cu JOIN j1 USING (msno) JOIN j2 USING (msno) JOIN j3 USING (msno) JOIN train USING (msno)""",
    "tx", "tx_ev", "user_logs", "members", "train", extra=[
        *TX_PROFILE_CTES, ("j1", TX_PROFILE_SELECT),
        ("j2", f"SELECT * EXCLUDE (registration_date) FROM ({MEMBER_CLEAN_SQL}) m"),
        ("cu", COMMON_USERS_SQL),
        ("b", """SELECT msno, min(transaction_date) AS first_transaction_date,
       max(transaction_date) AS last_transaction_date FROM tx_ev GROUP BY msno"""),
        ("p1", _p1_sql()),
        ("an", "SELECT p1.msno, last_login_date, first_transaction_date, last_transaction_date "
               "FROM p1 LEFT JOIN b ON p1.msno = b.msno"),
        ("p2", _p2_sql()),
        ("j3", _j3_select()),
    ])


def build_feature_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return FT.feature_table(t.tx, t.tx_ev, t.user_logs, t.members, t.train,
                            MEMBER_LAST_DAY, LOG_LAST_DAY)


@register("feature_table", FEATURE_TABLE_SQL, "J4: J1 J2 J3 H1 C1 C2 C6 B10 B13 B14 E7")
def q_feature_table(spark, sf_dir):
    return build_feature_table(spark, sf_dir)

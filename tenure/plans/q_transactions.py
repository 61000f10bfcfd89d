"""Registered transaction queries (J1 and its parts, B1/B2, D9, D5+B12)."""

from __future__ import annotations

import datetime as _dt

from tenure.operators import transactions as X
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import Tables

ORDER_SQL = "transaction_date, seq1, seq2, payment_plan_days, is_cancel"
ORDER_SQL_DESC = ("transaction_date DESC, seq1 DESC, seq2 DESC, payment_plan_days DESC, "
                  "is_cancel DESC")
TIME_LEFT_SQL = ("CAST(date_diff('day', transaction_date, membership_expire_date) + 1 AS DOUBLE)"
                 " / (payment_plan_days + 1)")

# Cut-off of the paid-transaction filter on the fixture calendar (reference: 2015-02-28).
PAID_CUTOFF = _dt.date(1998, 2, 28)
# Year run of the yearly count on the fixture calendar (reference: 2004, 14 years).
YEAR_FIRST, YEAR_COUNT = 1994, 9
# Deadline of the derived churn label on the fixture calendar (reference: 2017-01-29).
EXPIRE_DEADLINE = _dt.date(2001, 6, 1)

_MODE_CTE = [
    ("pm", f"""SELECT msno, payment_method_id AS v,
       row_number() OVER (PARTITION BY msno ORDER BY count(*) DESC, payment_method_id) AS rn
       FROM tx GROUP BY msno, payment_method_id"""),
    ("pp", f"""SELECT msno, payment_plan_days AS v,
       row_number() OVER (PARTITION BY msno ORDER BY count(*) DESC, payment_plan_days) AS rn
       FROM tx GROUP BY msno, payment_plan_days"""),
]
_LAG_CTE = ("o", f"""SELECT *, lag(payment_plan_days) OVER (PARTITION BY msno ORDER BY {ORDER_SQL}) AS prev
       FROM tx""")
_LATEST_CTE = ("lc", f"""SELECT msno, is_cancel,
       row_number() OVER (PARTITION BY msno ORDER BY {ORDER_SQL_DESC}) AS rn FROM tx""")

TX_PROFILE_CTES = [
    _LAG_CTE, *_MODE_CTE, _LATEST_CTE,
    ("g", f"""SELECT msno, count(*) AS n,
       count(*) FILTER (WHERE payment_plan_days > prev) AS up,
       count(*) FILTER (WHERE payment_plan_days < prev) AS down,
       avg(CAST(is_auto_renew AS DOUBLE)) AS ar,
       count(*) FILTER (WHERE is_cancel = 1) AS cc,
       max(CASE WHEN is_cancel = 1 THEN {TIME_LEFT_SQL} END) AS tl,
       CAST(sum(is_cancel) AS BIGINT) AS tc, CAST(sum(payment_plan_days) AS BIGINT) AS tpd,
       sum(plan_list_price) AS tpp, sum(actual_amount_paid) AS tap
       FROM o GROUP BY msno""")]
TX_PROFILE_SELECT = """
SELECT g.msno, pm.v AS frequent_payment_method, pp.v AS frequent_payment_plan,
  round(g.ar, 6) AS autorenew_percent,
  round(CASE WHEN n <= 1 THEN 0.0 ELSE up::DOUBLE / (n - 1) END, 6) AS upgrades,
  round(CASE WHEN n <= 1 THEN 1.0 ELSE down::DOUBLE / (n - 1) END, 6) AS downgrades,
  round(CASE WHEN n <= 1 THEN 0.0 ELSE (n - 1 - up - down)::DOUBLE / (n - 1) END, 6) AS consistent,
  g.cc AS cancelled_counts, round(coalesce(g.tl, 0.0), 6) AS percent_time_left_when_cancelled,
  g.tc AS total_cancels, g.tpd AS total_plan_days, round(g.tpp, 6) AS total_plan_price,
  round(g.tap, 6) AS total_Actual_amount_paid, lc.is_cancel
FROM g JOIN pm ON pm.msno = g.msno AND pm.rn = 1
       JOIN pp ON pp.msno = g.msno AND pp.rn = 1
       JOIN lc ON lc.msno = g.msno AND lc.rn = 1"""
TX_PROFILE_SQL = with_views(TX_PROFILE_SELECT, "tx", extra=TX_PROFILE_CTES)


@register("tx_profile", TX_PROFILE_SQL, "J1: D2 D6 D7 D8 E1 E3")
def q_tx_profile(spark, sf_dir):
    return X.tx_profile(Tables(spark, sf_dir).tx)


@register("plan_change_shares", with_views(f"""
SELECT msno,
  round(CASE WHEN n <= 1 THEN 0.0 ELSE up::DOUBLE / (n - 1) END, 6) AS upgrades,
  round(CASE WHEN n <= 1 THEN 1.0 ELSE down::DOUBLE / (n - 1) END, 6) AS downgrades,
  round(CASE WHEN n <= 1 THEN 0.0 ELSE (n - 1 - up - down)::DOUBLE / (n - 1) END, 6) AS consistent
FROM (SELECT msno, count(*) AS n,
             count(*) FILTER (WHERE payment_plan_days > prev) AS up,
             count(*) FILTER (WHERE payment_plan_days < prev) AS down
      FROM o GROUP BY msno) s""", "tx", extra=[_LAG_CTE]), "E1")
def q_plan_change_shares(spark, sf_dir):
    return X.plan_change_shares(Tables(spark, sf_dir).tx)


@register("frequent_payment", with_views("""
SELECT pm.msno, pm.v AS frequent_payment_method, pp.v AS frequent_payment_plan
FROM pm JOIN pp ON pm.msno = pp.msno AND pp.rn = 1 WHERE pm.rn = 1""", "tx", extra=_MODE_CTE),
          "D6 G5")
def q_frequent_payment(spark, sf_dir):
    return X.frequent_payment(Tables(spark, sf_dir).tx)


@register("cancel_time_left", with_views(f"""
SELECT msno, count(*) FILTER (WHERE is_cancel = 1) AS cancelled_counts,
       round(coalesce(max(CASE WHEN is_cancel = 1 THEN {TIME_LEFT_SQL} END), 0.0), 6)
         AS percent_time_left_when_cancelled
FROM tx GROUP BY msno""", "tx"), "D8 B21")
def q_cancel_time_left(spark, sf_dir):
    return X.cancel_time_left(Tables(spark, sf_dir).tx)


@register("autorenew_share", with_views("""
SELECT msno, round(avg(CAST(is_auto_renew AS DOUBLE)), 6) AS autorenew_percent
FROM tx GROUP BY msno""", "tx"), "D7")
def q_autorenew_share(spark, sf_dir):
    return X.autorenew_share(Tables(spark, sf_dir).tx)


@register("spend_totals", with_views("""
SELECT msno, CAST(sum(is_cancel) AS BIGINT) AS total_cancels,
       CAST(sum(payment_plan_days) AS BIGINT) AS total_plan_days,
       round(sum(plan_list_price), 6) AS total_plan_price,
       round(sum(actual_amount_paid), 6) AS total_Actual_amount_paid
FROM tx GROUP BY msno""", "tx"), "D2")
def q_spend_totals(spark, sf_dir):
    return X.spend_totals(Tables(spark, sf_dir).tx)


@register("latest_cancel_flag", with_views("""
SELECT msno, is_cancel FROM lc WHERE rn = 1""", "tx", extra=[_LATEST_CTE]), "E3")
def q_latest_cancel_flag(spark, sf_dir):
    return X.latest_cancel_flag(Tables(spark, sf_dir).tx)


@register("tx_bounds", with_views("""
SELECT msno, min(transaction_date) AS first_transaction_date,
       max(transaction_date) AS last_transaction_date
FROM tx GROUP BY msno""", "tx"), "E2")
def q_tx_bounds(spark, sf_dir):
    return X.tx_bounds(Tables(spark, sf_dir).tx)


@register("paid_since_cutoff", with_views(f"""
SELECT msno, payment_method_id, payment_plan_days, round(plan_list_price, 6) AS plan_list_price,
       round(actual_amount_paid, 6) AS actual_amount_paid, is_auto_renew, transaction_date,
       membership_expire_date, is_cancel, seq1, seq2
FROM tx WHERE transaction_date > DATE '{PAID_CUTOFF}'
  AND actual_amount_paid IS DISTINCT FROM 0.0""", "tx"), "B1 B2")
def q_paid_since_cutoff(spark, sf_dir):
    return X.paid_since(Tables(spark, sf_dir).tx, PAID_CUTOFF)


@register("tx_per_year", with_views(f"""
SELECT CAST(y.year AS INT) AS year, CAST(coalesce(c.n, 0) AS BIGINT) AS n_transactions
FROM range({YEAR_FIRST}, {YEAR_FIRST + YEAR_COUNT}) y(year)
LEFT JOIN (SELECT year(transaction_date) AS yr, count(*) AS n FROM tx GROUP BY 1) c
  ON c.yr = y.year""", "tx"), "D9")
def q_tx_per_year(spark, sf_dir):
    return X.tx_per_year(Tables(spark, sf_dir).tx, YEAR_FIRST, YEAR_COUNT)


@register("derived_churn_label", with_views(f"""
SELECT msno, max(membership_expire_date) AS max_expire_date,
       CASE WHEN max(membership_expire_date) < DATE '{EXPIRE_DEADLINE}' THEN 1 ELSE 0 END AS is_churn
FROM tx GROUP BY msno""", "tx"), "D5 B12")
def q_derived_churn_label(spark, sf_dir):
    return X.derived_churn_label(Tables(spark, sf_dir).tx, EXPIRE_DEADLINE)

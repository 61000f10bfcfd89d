"""Registered interval-join queries."""

from __future__ import annotations

from tenure.operators import intervals as I
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import Tables
from tenure.sources.schemas import LOG_METRICS

_MEANS_SQL = ", ".join(f"round(avg(l.{m}), 6) AS {m}" for m in LOG_METRICS)
_JOIN_SQL = """FROM tx_ev x LEFT JOIN user_logs l
  ON l.msno = x.msno AND l.date > x.transaction_date AND l.date < x.membership_expire_date"""


@register("interval_log_means", with_views(f"""
SELECT x.tx_id, x.msno, {_MEANS_SQL}
{_JOIN_SQL}
GROUP BY x.tx_id, x.msno""", "tx_ev", "user_logs"), "C8 B6")
def q_interval_log_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.interval_log_means(t.tx_ev, t.user_logs)


@register("first_model_rows", with_views(f"""
SELECT x.tx_id, x.msno, {_MEANS_SQL}, x.payment_plan_days
{_JOIN_SQL}
GROUP BY x.tx_id, x.msno, x.payment_plan_days HAVING count(l.msno) > 0""", "tx_ev", "user_logs"),
          "J5 B11")
def q_first_model_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.first_model_rows(t.tx_ev, t.user_logs, carry=["payment_plan_days"])

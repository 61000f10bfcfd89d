"""The full per-user feature table with its label.

Plan shape: the usage block (J3), a row per user, is computed first and
written to the shared folder.  Its users, reduced to those with a member row
and a label, are the common users (H1); they are semi-joined into the
transactions (C1), the most expensive block, before anything else touches
them.  All blocks are keyed by ``msno`` for the final joins.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame

from tenure.operators import logs as L
from tenure.operators import members as M
from tenure.operators import transactions as X
from tenure.operators import universe as U
from tenure.session import stage_shared
from tenure.sources.schemas import LOG_METRICS

CATEGORICAL = ["frequent_payment_method", "frequent_payment_plan", "city", "gender", "registered_via"]


def feature_columns() -> list[str]:
    """Column order of the feature table (label last)."""
    sfx = [L.METRIC_SUFFIX[m] for m in LOG_METRICS]
    return (["msno", "frequent_payment_method", "frequent_payment_plan", "autorenew_percent",
             "upgrades", "downgrades", "consistent", "cancelled_counts",
             "percent_time_left_when_cancelled", "city", "bd", "gender", "registered_via",
             "associated_time", "days_since_last_login", "total_cancels", "total_plan_days",
             "total_plan_price", "total_Actual_amount_paid"]
            + [f"avg_{s}" for s in sfx] + [f"z_{s}" for s in sfx]
            + [f"z_{s}_3014" for s in sfx] + [f"z_{s}_147" for s in sfx]
            + ["login_diff_3014", "login_diff_147", "is_cancel", "is_churn"])


def feature_table(tx: DataFrame, tx_ev: DataFrame, logs: DataFrame, members: DataFrame,
                  train: DataFrame, member_last_day: _dt.date, log_last_day: _dt.date,
                  users: DataFrame | None = None) -> DataFrame:
    """One row per common user (H1): J1 + J2 + J3 + label.

    ``tx_ev`` (transactions on the log calendar) gives the first/last
    transaction dates for E4.  Attributes and the label are attached by key
    joins on ``msno`` (C2); the reference's positional assignments (C5, C6)
    have no counterpart.

    ``users`` (e.g. a stratified label sample, as the reference draws) is
    semi-joined into every input first (C1), so a small sample costs only
    its own rows.
    """
    if users is not None:
        tx, tx_ev, logs, members, train = (U.keep_users(d, users)
                                           for d in (tx, tx_ev, logs, members, train))
    j2 = M.member_clean(members, member_last_day).drop("registration_date")
    labels = train.select("msno", "is_churn")
    j3 = stage_shared(L.log_block(logs, X.tx_bounds(tx_ev), log_last_day), "usage_block")
    common = U.keep_users(U.keep_users(j3.select("msno"), members.select("msno")), labels.select("msno"))
    j1 = X.tx_profile(U.keep_users(tx, common))
    out = j1.join(j2, "msno").join(j3, "msno").join(labels, "msno")
    return out.select(*feature_columns())

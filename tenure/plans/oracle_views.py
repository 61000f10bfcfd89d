"""DuckDB text of the fixture views, used as CTEs by the oracle SQL.

Same meaning as ``tenure.sources.fixtures``; only the dialect-specific
expressions differ (JSON access, date arithmetic, date formatting).
"""

from __future__ import annotations

VIEW_SQL = {
    "tx": """
SELECT o_custkey AS msno, l_linenumber AS payment_method_id,
       CAST(l_quantity AS INT) AS payment_plan_days, l_extendedprice AS plan_list_price,
       CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS actual_amount_paid,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_auto_renew,
       CAST(o_orderdate AS DATE) AS transaction_date,
       CAST(l_shipdate AS DATE) AS membership_expire_date,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_cancel,
       l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "user_logs": """
SELECT user_id AS msno, CAST(ts AS DATE) AS date,
       count(*) FILTER (WHERE event_type = 'view')     AS num_25,
       count(*) FILTER (WHERE event_type = 'click')    AS num_50,
       count(*) FILTER (WHERE event_type = 'signup')   AS num_75,
       count(*) FILTER (WHERE event_type = 'error')    AS num_985,
       count(*) FILTER (WHERE event_type = 'purchase') AS num_100,
       count(DISTINCT CAST(props->>'k' AS INT)) AS num_unq, sum(value) AS total_secs
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "tx_ev": """
SELECT user_id AS msno, event_id AS tx_id, CAST(ts AS DATE) AS transaction_date,
       CAST(ts AS DATE) + (CAST(event_id % 7 AS INT) + 1) AS membership_expire_date,
       CAST(event_id % 7 AS INT) + 1 AS payment_plan_days
FROM events WHERE event_type = 'purchase'""",
    "members": """
SELECT c_custkey AS msno, c_nationkey AS city, CAST(floor(c_acctbal / 100) AS INT) AS bd,
       nullif(c_mktsegment, 'MACHINERY') AS gender, CAST(c_custkey % 5 AS INT) AS registered_via,
       CAST(strftime(DATE '2015-01-01' + CAST(c_custkey % 700 AS INT), '%Y%m%d') AS INT)
         AS registration_init_time
FROM customer""",
    "train": """
SELECT o_custkey AS msno,
       CASE WHEN max(CAST(o_orderdate AS DATE)) < DATE '2001-03-01' THEN 1 ELSE 0 END AS is_churn
FROM orders GROUP BY o_custkey""",
    "scored": """
SELECT msno, is_churn, CAST((msno * 7919) % 997 AS DOUBLE) / 997 AS p1 FROM train""",
}

# CTE dependencies between views.
VIEW_DEPS = {"scored": ["train"]}
_ORDER = ["tx", "user_logs", "tx_ev", "members", "train", "scored"]


def with_views(sql: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``views`` (plus dependencies) and ``extra`` CTEs."""
    need: set[str] = set()
    stack = list(views)
    while stack:
        v = stack.pop()
        if v not in need:
            need.add(v)
            stack.extend(VIEW_DEPS.get(v, []))
    parts = [f"{v} AS ({VIEW_SQL[v]}\n)" for v in _ORDER if v in need]
    parts += [f"{name} AS ({body}\n)" for name, body in (extra or [])]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql

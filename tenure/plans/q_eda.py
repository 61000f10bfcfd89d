"""Registered exploration queries."""

from __future__ import annotations

from tenure.functions.bins import interval_labels
from tenure.operators import eda as D
from tenure.operators import members as M
from tenure.operators import transactions as X
from tenure.plans.oracle_views import with_views
from tenure.plans.q_members import MEMBER_CLEAN_SQL
from tenure.plans.q_transactions import _LAG_CTE
from tenure.plans.registry import register
from tenure.sources.fixtures import MEMBER_LAST_DAY, Tables, read_table

_DISCOUNT_PU = ("pu", """SELECT tx.msno, count(t.is_churn) AS total_transactions,
       count(CASE WHEN plan_list_price - actual_amount_paid > 0 THEN t.is_churn END)
         AS discounted_transactions,
       count(*) FILTER (WHERE plan_list_price - actual_amount_paid > 0) AS nd,
       max(t.is_churn) AS is_churn
       FROM tx LEFT JOIN train t ON tx.msno = t.msno GROUP BY tx.msno""")
_DISCOUNT_CT = ("dc", """SELECT total_transactions - discounted_transactions AS no_discount_transactions,
       count(*) FILTER (WHERE is_churn = 0) AS n_retained,
       count(*) FILTER (WHERE is_churn = 1) AS n_churned,
       CAST(count(*) FILTER (WHERE is_churn = 1) AS DOUBLE) * 100.0 / count(*) AS churn_rate
       FROM pu WHERE nd > 0 AND is_churn IS NOT NULL GROUP BY 1""")


@register("discount_churn", with_views("""
SELECT no_discount_transactions, n_retained, n_churned, round(churn_rate, 6) AS churn_rate FROM dc""",
    "tx", "train", extra=[_DISCOUNT_PU, _DISCOUNT_CT]), "B3 D1 D17 C4 D14 D15")
def q_discount_churn(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.discount_churn(t.tx, t.train)


@register("rate_histogram", with_views("""
SELECT CAST(eb.bin AS INT) AS bin, eb.lower_edge, eb.upper_edge,
  (SELECT count(*) FROM dc WHERE dc.churn_rate >= eb.lower_edge
     AND (dc.churn_rate < eb.upper_edge
          OR (eb.upper_edge = (SELECT max(v) FROM e) AND dc.churn_rate = eb.upper_edge))) AS n
FROM eb WHERE eb.upper_edge IS NOT NULL""", "tx", "train", extra=[
    _DISCOUNT_PU, _DISCOUNT_CT,
    ("e", "SELECT DISTINCT CAST(no_discount_transactions AS DOUBLE) AS v FROM dc"),
    ("eb", """SELECT v AS lower_edge, lead(v) OVER (ORDER BY v) AS upper_edge,
       row_number() OVER (ORDER BY v) AS bin FROM e""")]), "F6")
def q_rate_histogram(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = D.discount_churn(t.tx, t.train)
    return D.rate_histogram(d, "churn_rate", d, "no_discount_transactions")


def _binned_sql(value: str, n: int, labels: list[str] | None) -> str:
    label_sql = ""
    if labels:
        arr = ", ".join(f"'{s}'" for s in labels)
        label_sql = f", [{arr}][s.bin] AS bin_label"
    return with_views(f"""
SELECT CAST(s.bin AS INT) AS bin, round(mn + (s.bin - 1) * w, 6) AS lower_edge,
       round(mn + s.bin * w, 6) AS upper_edge, round(pb.m, 6) AS mean_churn_rate,
       coalesce(pb.nv, 0) AS n_values{label_sql}
FROM range(1, {n + 1}) s(bin) CROSS JOIN mm LEFT JOIN pb ON pb.bin = s.bin""", "tx", "train", extra=[
        _LAG_CTE,
        ("sh", """SELECT msno,
       CASE WHEN n <= 1 THEN 1.0 ELSE down::DOUBLE / (n - 1) END AS downgrades,
       CASE WHEN n <= 1 THEN 0.0 ELSE (n - 1 - up - down)::DOUBLE / (n - 1) END AS consistent
       FROM (SELECT msno, count(*) AS n,
             count(*) FILTER (WHERE payment_plan_days > prev) AS up,
             count(*) FILTER (WHERE payment_plan_days < prev) AS down FROM o GROUP BY msno) q"""),
        ("ct", f"""SELECT {value} AS v, count(*) FILTER (WHERE is_churn = 0) AS n0,
       count(*) FILTER (WHERE is_churn = 1) AS n1,
       CAST(count(*) FILTER (WHERE is_churn = 1) AS DOUBLE) * 100.0 / count(*) AS rate
       FROM sh JOIN train ON sh.msno = train.msno WHERE is_churn IS NOT NULL GROUP BY {value}"""),
        ("mm", f"SELECT min(v) AS mn, max(v) AS mx, (max(v) - min(v)) / {float(n)} AS w FROM ct"),
        ("bb", f"""SELECT CASE WHEN w = 0 THEN {(n + 1) // 2}
       ELSE least(greatest(CAST(ceil((v - mn) / w) AS INT), 1), {n}) END AS bin, rate FROM ct, mm"""),
        ("pb", "SELECT bin, avg(rate) AS m, count(*) AS nv FROM bb GROUP BY bin"),
    ])


@register("downgrade_churn_bins", _binned_sql("downgrades", 10, None), "D14 D15 F1 F4")
def q_downgrade_churn_bins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.binned_churn_rate(X.plan_change_shares(t.tx), t.train, "downgrades", 10)


@register("consistent_churn_bins", _binned_sql("consistent", 10, D.CONSISTENT_LABELS),
          "D14 D15 F1 F3 F4")
def q_consistent_churn_bins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.binned_churn_rate(X.plan_change_shares(t.tx), t.train, "consistent", 10,
                               D.CONSISTENT_LABELS)


def _age_case(col: str) -> str:
    e = D.AGE_EDGES
    whens = " ".join(f"WHEN {col} > {e[k - 1]} AND {col} <= {e[k]} THEN {k}" for k in range(1, len(e)))
    return f"CASE {whens} END"


_AGE_LABELS = "[" + ", ".join(f"'{s}'" for s in interval_labels(D.AGE_EDGES)) + "]"


@register("age_churn_bins", with_views(f"""
SELECT CAST(s.bin AS INT) AS bin, {_AGE_LABELS}[s.bin] AS age_bin, round(pb.m, 6) AS mean_churn_rate
FROM range(1, {len(D.AGE_EDGES)}) s(bin) LEFT JOIN pb ON pb.bin = s.bin""", "members", "train", extra=[
    ("mc", MEMBER_CLEAN_SQL),
    ("ct", """SELECT bd, CAST(count(*) FILTER (WHERE is_churn = 1) AS DOUBLE) * 100.0 / count(*) AS rate
       FROM mc JOIN train ON mc.msno = train.msno WHERE is_churn IS NOT NULL GROUP BY bd"""),
    ("pb", f"""SELECT {_age_case('bd')} AS bin, avg(rate) AS m FROM ct
       WHERE {_age_case('bd')} IS NOT NULL GROUP BY 1""")]), "F2 F4")
def q_age_churn_bins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.age_churn_bins(M.member_clean(t.members, MEMBER_LAST_DAY), t.train)


@register("age_group_counts", with_views(f"""
SELECT CAST(s.bin AS INT) AS bin, {_AGE_LABELS}[s.bin] AS age_group, coalesce(pb.n, 0) AS n_users
FROM range(1, {len(D.AGE_EDGES)}) s(bin) LEFT JOIN pb ON pb.bin = s.bin""", "members", "tx", extra=[
    ("mc", MEMBER_CLEAN_SQL),
    ("cc", "SELECT msno, count(*) FILTER (WHERE is_cancel = 1) AS cancelled_counts FROM tx GROUP BY msno"),
    ("pb", f"""SELECT {_age_case('bd')} AS bin, count(cc.cancelled_counts) AS n
       FROM mc LEFT JOIN cc ON mc.msno = cc.msno WHERE {_age_case('bd')} IS NOT NULL GROUP BY 1""")]),
    "F2 F5")
def q_age_group_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.age_group_counts(M.member_clean(t.members, MEMBER_LAST_DAY), X.cancel_time_left(t.tx))


_TOTAL_SQL = ("CAST(coalesce(num_25, 0) + coalesce(num_50, 0) + coalesce(num_75, 0) "
              "+ coalesce(num_985, 0) + coalesce(num_100, 0) AS DOUBLE)")


@register("repeat_listening", with_views(f"""
SELECT is_churn, round(avg(m), 6) AS mean_of_mean, round(avg(s), 6) AS mean_of_std
FROM (SELECT msno, avg(rp) AS m, stddev_samp(rp) AS s
      FROM (SELECT msno, (t - num_unq) / nullif(t, 0) AS rp
            FROM (SELECT *, {_TOTAL_SQL} AS t FROM user_logs) a) b GROUP BY msno) pu
LEFT JOIN train USING (msno) WHERE is_churn IS NOT NULL GROUP BY is_churn""", "user_logs", "train"),
          "B16 B17 D4 D16")
def q_repeat_listening(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.repeat_listening(t.user_logs, t.train)


@register("share_num25_by_class", with_views(f"""
SELECT is_churn, round(avg(m), 6) AS mean_of_mean, round(stddev_samp(m), 6) AS std_of_mean,
       round(avg(s), 6) AS mean_of_std, round(stddev_samp(s), 6) AS std_of_std
FROM (SELECT msno, avg(sh) AS m, stddev_samp(sh) AS s
      FROM (SELECT msno, num_25 / nullif(t, 0) AS sh
            FROM (SELECT *, {_TOTAL_SQL} AS t FROM user_logs) a) b GROUP BY msno) pu
LEFT JOIN train USING (msno) WHERE is_churn IS NOT NULL GROUP BY is_churn""", "user_logs", "train"),
          "B18 D4 D16 T9")
def q_share_num25_by_class(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return D.share_num25_by_class(t.user_logs, t.train)


@register("calendar_fill", with_views("""
SELECT u.msno, d.date, CAST(coalesce(l.num_100, 0) AS DOUBLE) AS num_100
FROM (SELECT DISTINCT msno FROM user_logs) u
CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM user_logs),
                   (SELECT max(date) FROM user_logs), INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN user_logs l ON l.msno = u.msno AND l.date = d.date""", "user_logs"), "C7 B9")
def q_calendar_fill(spark, sf_dir):
    logs = Tables(spark, sf_dir).user_logs
    return D.calendar_fill(logs, logs.select("msno").distinct(), *D.calendar_of(logs))


@register("logs_right_labels", with_views("""
SELECT t.msno AS msno, l.date, l.num_25, l.num_50, l.num_75, l.num_985, l.num_100, l.num_unq,
       round(l.total_secs, 6) AS total_secs, t.is_churn
FROM user_logs l RIGHT JOIN train t ON l.msno = t.msno""", "user_logs", "train"), "C3")
def q_logs_right_labels(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log_users = read_table(spark, sf_dir, "events").selectExpr("user_id AS msno")
    return D.logs_right_labels(t.user_logs, t.train, log_users)

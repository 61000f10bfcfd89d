"""Registered member and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import members as M
from tenure.operators import universe as U
from tenure.operators.transactions import TX_ORDER
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import MEMBER_LAST_DAY, Tables

MEMBER_CLEAN_SQL = f"""
SELECT msno, city, CASE WHEN bd > 90 OR bd < 1 THEN 26 ELSE bd END AS bd,
       coalesce(gender, 'Not_given') AS gender, registered_via,
       try_strptime(CAST(registration_init_time AS VARCHAR), '%Y%m%d')::DATE AS registration_date,
       CAST(date_diff('day', try_strptime(CAST(registration_init_time AS VARCHAR), '%Y%m%d')::DATE,
                      DATE '{MEMBER_LAST_DAY}') AS INT) AS associated_time
FROM members"""


@register("member_clean", with_views(MEMBER_CLEAN_SQL, "members"), "B7 B8 B9 B20 J2")
def q_member_clean(spark, sf_dir):
    return M.member_clean(Tables(spark, sf_dir).members, MEMBER_LAST_DAY)


_MEMBER_COLS = ["msno", "city", "bd", "gender", "registered_via", "registration_init_time"]


@register("column_distinct_profile", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    f" AS BIGINT) AS n_distinct FROM members" for c in _MEMBER_COLS), "members"), "D11")
def q_column_distinct_profile(spark, sf_dir):
    return M.column_distinct_profile(Tables(spark, sf_dir).members)


_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_shipdate", "l_returnflag"]
SKETCH_ERROR = 0.03


@register("column_distinct_sketch", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, true AS sketch_agrees FROM lineitem"
    for c in _LINE_COLS), "D11 by sketches, beside the exact counts")
def q_column_distinct_sketch(spark, sf_dir):
    lines = Tables(spark, sf_dir).raw("lineitem").select(*_LINE_COLS)
    sketched = M.column_distinct_sketch(lines).withColumnRenamed("n_distinct", "about")
    return M.column_distinct_profile(lines).join(sketched, "column_name").select(
        "column_name", "n_distinct", (F.abs(F.col("about") - F.col("n_distinct")) <= SKETCH_ERROR * F.col("n_distinct"))
        .alias("sketch_agrees"))


@register("object_summary", with_views("""
SELECT 'gender' AS column_name, CAST(sum(freq) AS BIGINT) AS count, count(*) AS unique,
       arg_min(value, (-freq, value)) AS top, max(freq) AS freq
FROM (SELECT gender AS value, count(*) AS freq FROM members WHERE gender IS NOT NULL GROUP BY gender) v""",
                                       "members"), "D12")
def q_object_summary(spark, sf_dir):
    return M.object_summary(Tables(spark, sf_dir).members, ["gender"])


@register("registered_via_counts", with_views("""
SELECT registered_via, count(*) AS n FROM members GROUP BY registered_via""", "members"), "D13")
def q_registered_via_counts(spark, sf_dir):
    return M.value_counts(Tables(spark, sf_dir).members, "registered_via")


COMMON_USERS_SQL = """
SELECT msno FROM user_logs INTERSECT SELECT msno FROM train
INTERSECT SELECT msno FROM tx INTERSECT SELECT msno FROM members"""


def _common(t: Tables):
    return U.common_users(t.user_logs, t.train, t.tx, t.members)


@register("common_users", with_views(COMMON_USERS_SQL, "user_logs", "train", "tx", "members"),
          "H1 D10")
def q_common_users(spark, sf_dir):
    return _common(Tables(spark, sf_dir))


@register("common_user_count", with_views(f"""
SELECT count(*) AS n_users FROM ({COMMON_USERS_SQL}) c""", "user_logs", "train", "tx", "members"),
          "H1 D18")
def q_common_user_count(spark, sf_dir):
    from pyspark.sql import functions as F
    return _common(Tables(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_users"))


@register("common_user_tables", with_views(f"""
SELECT 'members' AS table_name, count(*) AS n_rows FROM members WHERE msno IN (SELECT msno FROM cu)
UNION ALL SELECT 'tx', count(*) FROM tx WHERE msno IN (SELECT msno FROM cu)
UNION ALL SELECT 'user_logs', count(*) FROM user_logs WHERE msno IN (SELECT msno FROM cu)
UNION ALL SELECT 'train', count(*) FROM train WHERE msno IN (SELECT msno FROM cu)""",
    "user_logs", "train", "tx", "members", extra=[("cu", COMMON_USERS_SQL)]), "C1 A3 D19")
def q_common_user_tables(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cu = _common(t)
    return U.table_row_counts({
        "members": U.keep_users(t.members, cu), "tx": U.keep_users(t.tx, cu),
        "user_logs": U.keep_users(t.user_logs, cu), "train": U.keep_users(t.train, cu)})


LOOKUP_ROWS = 5


@register("user_lookup", with_views(f"""
SELECT * FROM tx WHERE msno = (SELECT min(o_custkey) FROM orders)
ORDER BY transaction_date, seq1, seq2, payment_plan_days, is_cancel LIMIT {LOOKUP_ROWS}""", "tx"), "B5 G1 G3")
def q_user_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = t.raw("orders").agg({"o_custkey": "min"}).first()[0]
    return U.user_rows(t.tx, first, TX_ORDER, n=LOOKUP_ROWS)

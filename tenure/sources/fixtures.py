"""The retention tables expressed over the driver's parquet tables.

The driver ships TPC-H-like tables plus an ``events`` stream.  These views
map them onto the retention data model (members, transactions, daily usage
logs, churn labels) exactly as ``FIXTURES.md`` §3 prints them.  They are
ordinary lazy DataFrames: Catalyst prunes columns into the parquet scans and
pushes later filters through the joins.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (FIXTURES.md §3).
MEMBER_REGISTRATION_BASE = _dt.date(2015, 1, 1)
MEMBER_REGISTRATION_SPAN = 700
GENDER_NULL_SEGMENT = "MACHINERY"
CHURN_CUTOFF = _dt.date(2001, 3, 1)
SCORE_MULTIPLIER = 7919
SCORE_MODULUS = 997
EVENT_TYPE_TO_COUNTER = [
    ("view", "num_25"),
    ("click", "num_50"),
    ("signup", "num_75"),
    ("error", "num_985"),
    ("purchase", "num_100"),
]
# Last day of the usage-log calendar, and the reference's member "today".
LOG_LAST_DAY = _dt.date(2024, 1, 30)
LOG_FIRST_DAY = _dt.date(2024, 1, 1)
MEMBER_LAST_DAY = _dt.date(2017, 2, 28)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription transactions: one row per line item, user = order's customer."""
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("msno"),
        F.col("l_linenumber").alias("payment_method_id"),
        F.col("l_quantity").cast("int").alias("payment_plan_days"),
        F.col("l_extendedprice").alias("plan_list_price"),
        F.when(F.col("l_tax") == 0, F.lit(0.0))
         .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual_amount_paid"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_auto_renew"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("l_shipdate").cast("date").alias("membership_expire_date"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_cancel"),
        F.col("l_orderkey").alias("seq1"),
        F.col("l_linenumber").alias("seq2"),
    )


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage logs: one row per (user, day) with play counters.

    Two plain aggregations, (user, day, k) then (user, day), instead of a
    DISTINCT aggregate, which Spark would evaluate by expanding every row.
    ``num_unq`` counts the non-null k groups, i.e. COUNT(DISTINCT k).
    """
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    per_k = (ev.groupBy(F.col("user_id").alias("msno"), F.col("ts").cast("date").alias("date"),
                        k.alias("_k"))
               .agg(*[F.count_if(F.col("event_type") == t).alias(c) for t, c in EVENT_TYPE_TO_COUNTER],
                    F.sum("value").alias("_v")))
    return per_k.groupBy("msno", "date").agg(
        *[F.sum(c).alias(c) for _, c in EVENT_TYPE_TO_COUNTER],
        F.count("_k").alias("num_unq"), F.sum("_v").alias("total_secs"))


def tx_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions on the log calendar, taken from purchase events (unique tx_id)."""
    ev = read_table(spark, sf_dir, "events")
    plan = (F.col("event_id") % 7).cast("int") + 1
    d = F.col("ts").cast("date")
    return (ev.filter(F.col("event_type") == "purchase")
              .select(F.col("user_id").alias("msno"), F.col("event_id").alias("tx_id"),
                      d.alias("transaction_date"),
                      F.date_add(d, plan).alias("membership_expire_date"),
                      plan.alias("payment_plan_days")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_table(spark, sf_dir, "customer")
    reg = F.date_add(F.lit(MEMBER_REGISTRATION_BASE),
                     (F.col("c_custkey") % MEMBER_REGISTRATION_SPAN).cast("int"))
    return cu.select(
        F.col("c_custkey").alias("msno"),
        F.col("c_nationkey").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
        F.nullif(F.col("c_mktsegment"), F.lit(GENDER_NULL_SEGMENT)).alias("gender"),
        (F.col("c_custkey") % 5).cast("int").alias("registered_via"),
        F.date_format(reg, "yyyyMMdd").cast("int").alias("registration_init_time"),
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = read_table(spark, sf_dir, "orders")
    return (od.groupBy(F.col("o_custkey").alias("msno"))
              .agg(F.when(F.max(F.col("o_orderdate").cast("date")) < F.lit(CHURN_CUTOFF), 1)
                    .otherwise(0).alias("is_churn")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores for the metric operators: (msno, is_churn, p1)."""
    t = train(spark, sf_dir)
    return t.select("msno", "is_churn",
                    (((F.col("msno") * SCORE_MULTIPLIER) % SCORE_MODULUS).cast("double")
                     / SCORE_MODULUS).alias("p1"))


VIEWS = {
    "tx": tx,
    "user_logs": user_logs,
    "tx_ev": tx_ev,
    "members": members,
    "train": train,
    "scored": scored,
}


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).tx`` etc.  Each access builds a fresh plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self.spark, self.sf_dir)
        raise AttributeError(name)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

"""Declared schemas of the four retention tables (no inference at read time).

Dates arrive as integers ``yyyymmdd`` in the raw files; ``functions.dates``
turns them into ``DATE``.  The user id is a string in the raw files; the
operators never depend on its type.
"""

from pyspark.sql import types as T

MEMBERS = T.StructType([
    T.StructField("msno", T.StringType(), False),
    T.StructField("city", T.IntegerType(), True),
    T.StructField("bd", T.IntegerType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("registered_via", T.IntegerType(), True),
    T.StructField("registration_init_time", T.IntegerType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("msno", T.StringType(), False),
    T.StructField("payment_method_id", T.IntegerType(), True),
    T.StructField("payment_plan_days", T.IntegerType(), True),
    T.StructField("plan_list_price", T.DoubleType(), True),
    T.StructField("actual_amount_paid", T.DoubleType(), True),
    T.StructField("is_auto_renew", T.IntegerType(), True),
    T.StructField("transaction_date", T.IntegerType(), True),
    T.StructField("membership_expire_date", T.IntegerType(), True),
    T.StructField("is_cancel", T.IntegerType(), True),
])

USER_LOGS = T.StructType([
    T.StructField("msno", T.StringType(), False),
    T.StructField("date", T.IntegerType(), True),
    T.StructField("num_25", T.LongType(), True),
    T.StructField("num_50", T.LongType(), True),
    T.StructField("num_75", T.LongType(), True),
    T.StructField("num_985", T.LongType(), True),
    T.StructField("num_100", T.LongType(), True),
    T.StructField("num_unq", T.LongType(), True),
    T.StructField("total_secs", T.DoubleType(), True),
])

TRAIN = T.StructType([
    T.StructField("msno", T.StringType(), False),
    T.StructField("is_churn", T.IntegerType(), True),
])

BY_NAME = {
    "members": MEMBERS,
    "transactions": TRANSACTIONS,
    "user_logs": USER_LOGS,
    "train": TRAIN,
}

# Integer yyyymmdd columns per table, converted to DATE by read_retention_csv.
DATE_COLUMNS = {
    "members": ["registration_init_time"],
    "transactions": ["transaction_date", "membership_expire_date"],
    "user_logs": ["date"],
    "train": [],
}

# The seven numeric usage columns of a daily log row, in reference order.
LOG_METRICS = ["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]
# The five play-share counters.
PLAY_COUNTERS = ["num_25", "num_50", "num_75", "num_985", "num_100"]

"""Registered stream and sink queries.

These run their job when built (the stream drains, the files are written)
and return the table read back from the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import sampling as SMP
from tenure.plans.oracle_views import with_views
from tenure.plans.q_sampling import PER_CLASS, SEED, _h
from tenure.plans.registry import register
from tenure.session import stage_shared
from tenure.sources import io
from tenure.sources.fixtures import Tables, read_table
from tenure.streaming.log_filter import run_folder, stream_keep_users

_SAMPLE_SQL = "\nUNION ALL\n".join(
    f"(SELECT msno FROM train WHERE is_churn = {v} ORDER BY {_h()} LIMIT {n})"
    for v, n in sorted(PER_CLASS.items()))


@register("stream_filter_append", with_views(f"""
SELECT * FROM events WHERE user_id IN (SELECT msno FROM ({_SAMPLE_SQL}) s)""", "train"),
          "N1 A3 C1", rounded=False)
def q_stream_filter_append(spark, sf_dir):
    t = Tables(spark, sf_dir)
    users = stage_shared(SMP.stratified_sample(t.train, "is_churn", PER_CLASS, seed=SEED)
                         .select(F.col("msno").alias("user_id")), "stream_users")
    schema = read_table(spark, sf_dir, "events").schema
    sink, ckpt = run_folder(spark, "stream_filter_append")
    return stream_keep_users(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, users, "user_id", sink, ckpt)


@register("members_csv_roundtrip", with_views("""
SELECT CAST(msno AS VARCHAR) AS msno, city, bd, gender, registered_via,
       try_strptime(CAST(registration_init_time AS VARCHAR), '%Y%m%d')::DATE AS registration_init_time
FROM members""", "members"), "A1 A2 A4")
def q_members_csv_roundtrip(spark, sf_dir):
    sink, _ = run_folder(spark, "members_csv")
    io.write_csv(Tables(spark, sf_dir).members, sink)
    return io.read_retention_csv(spark, sink, "members")


@register("staged_tx_bounds", with_views("""
SELECT msno, min(transaction_date) AS first_transaction_date,
       max(transaction_date) AS last_transaction_date FROM tx GROUP BY msno""", "tx"), "A5 A6 E2")
def q_staged_tx_bounds(spark, sf_dir):
    from tenure.operators import transactions as X
    sink, _ = run_folder(spark, "staged_tx_bounds")
    return io.stage(X.tx_bounds(Tables(spark, sf_dir).tx), sink)


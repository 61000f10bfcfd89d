"""Registered sampling queries.

Sample sizes are parameters; on the fixture they are scaled to its
population (reference sizes: 20,000 members; 856,851 / 1,500 majority rows;
5,000 + 10,000 per class; 2,500 draws; 70/30 split; slice [1:20] of 100).
"""

from __future__ import annotations

from tenure.operators import sampling as SMP
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import register
from tenure.sources.fixtures import Tables

SEED = 42
MEMBER_SAMPLE = 100
MAJORITY_SAMPLE = 500
PER_CLASS = {1: 300, 0: 600}
DRAWS = 250
TEST_FRACTION = 0.3
SLICE_OFFSET, SLICE_N = 1, 19


def _h(col: str = "msno", salt: str = "") -> str:
    return f"md5(concat('{SEED}:{salt}', CAST({col} AS VARCHAR)))"


def _hint(col: str = "msno", salt: str = "") -> str:
    return f"CAST(('0x' || substr({_h(col, salt)}, 1, 8)) AS BIGINT)"


@register("sample_exact", with_views(f"""
SELECT * FROM members ORDER BY {_h()} LIMIT {MEMBER_SAMPLE}""", "members"), "I1")
def q_sample_exact(spark, sf_dir):
    return SMP.sample_exact(Tables(spark, sf_dir).members, MEMBER_SAMPLE, seed=SEED)


@register("downsample_union", with_views(f"""
SELECT * FROM train WHERE is_churn <> 0
UNION ALL
(SELECT * FROM train WHERE is_churn = 0 ORDER BY {_h()} LIMIT {MAJORITY_SAMPLE})""", "train"), "I2 H2")
def q_downsample_union(spark, sf_dir):
    return SMP.downsample_majority(Tables(spark, sf_dir).train, "is_churn", 0, MAJORITY_SAMPLE, seed=SEED)


@register("stratified_sample", with_views("\nUNION ALL\n".join(
    f"(SELECT * FROM train WHERE is_churn = {v} ORDER BY {_h()} LIMIT {n})"
    for v, n in sorted(PER_CLASS.items())), "train"), "I3")
def q_stratified_sample(spark, sf_dir):
    return SMP.stratified_sample(Tables(spark, sf_dir).train, "is_churn", PER_CLASS, seed=SEED)


@register("sample_with_replacement", with_views(f"""
SELECT msno FROM num WHERE position IN (
  SELECT DISTINCT {_hint('range', 'd:')} % (SELECT count(*) FROM num) FROM range({DRAWS}))""",
    "train", extra=[("num", f"""SELECT msno, row_number() OVER (ORDER BY {_h()}) - 1 AS position
       FROM (SELECT DISTINCT msno FROM train) i""")]), "I4")
def q_sample_with_replacement(spark, sf_dir):
    return SMP.sample_with_replacement(Tables(spark, sf_dir).train, DRAWS, seed=SEED)


@register("train_test_split", with_views(f"""
SELECT msno, is_churn,
       CASE WHEN CAST({_hint()} AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) < CAST({1.0 - TEST_FRACTION!r} AS DOUBLE)
            THEN 'train' ELSE 'test' END AS split
FROM train""", "train"), "I5")
def q_train_test_split(spark, sf_dir):
    return SMP.train_test_split(Tables(spark, sf_dir).train, TEST_FRACTION, seed=SEED)


@register("sample_slice", with_views(f"""
SELECT * FROM train WHERE is_churn = 0 ORDER BY {_h()} LIMIT {SLICE_N} OFFSET {SLICE_OFFSET}""",
    "train"), "G4 I1")
def q_sample_slice(spark, sf_dir):
    from pyspark.sql import functions as F
    tr = Tables(spark, sf_dir).train.filter(F.col("is_churn") == 0)
    return SMP.sample_slice(tr, SLICE_OFFSET, SLICE_N, seed=SEED)

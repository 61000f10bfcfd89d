"""Registered encoding queries (K1-K6) over the member table and the feature table."""

from __future__ import annotations

from tenure.operators import encode as K
from tenure.operators import features as FT
from tenure.operators import members as M
from tenure.plans.oracle_views import with_views
from tenure.plans.q_features import FEATURE_TABLE_SQL, build_feature_table
from tenure.plans.q_members import MEMBER_CLEAN_SQL
from tenure.plans.registry import register, report
from tenure.session import cut_lineage
from tenure.sources.fixtures import MEMBER_LAST_DAY, Tables


@register("label_encoded", with_views("""
SELECT msno, gender, CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INT) AS gender_code
FROM mc""", "members", extra=[("mc", MEMBER_CLEAN_SQL)]), "K1")
def q_label_encoded(spark, sf_dir):
    mc = M.member_clean(Tables(spark, sf_dir).members, MEMBER_LAST_DAY).select("msno", "gender")
    return K.label_encode(mc, "gender", "gender_code")


_FT = f"(SELECT * FROM ({FEATURE_TABLE_SQL}) q)"


@register("one_hot_long", "\nUNION ALL\n".join(
    f"SELECT msno, '{c}@' || CAST(dense_rank() OVER (ORDER BY {c}) AS VARCHAR) AS feature, "
    f"CAST(1.0 AS DOUBLE) AS value FROM {_FT} ft{i}" for i, c in enumerate(FT.CATEGORICAL)),
    "K2 K3")
def q_one_hot_long(spark, sf_dir):
    # The codes and the rows both read the feature table: checkpoint it once
    # (shared checkpoint folder) instead of computing it twice.
    return K.one_hot_long(cut_lineage(build_feature_table(spark, sf_dir)), FT.CATEGORICAL)


_NUM = K.numeric_columns(FT.feature_columns(), FT.CATEGORICAL)
_LONG = "\nUNION ALL\n".join(f"SELECT msno, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM ft"
                             for c in _NUM)


@register("minmax_scaled", f"""
WITH ft AS {_FT},
lg AS (SELECT msno, feature, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 WHEN isinf(v) THEN 5.0 ELSE v END AS v
       FROM ({_LONG}) u),
st AS (SELECT feature, min(v) AS mn, max(v) AS mx FROM lg GROUP BY feature)
SELECT msno, lg.feature, round(CASE WHEN mx - mn = 0 THEN 0.0 ELSE (v - mn) / (mx - mn) END, 6) AS value
FROM lg JOIN st ON lg.feature = st.feature""", "K4 K6 B9 B10")
def q_minmax_scaled(spark, sf_dir):
    # Scaled from the reported (6-place) feature table, as the oracle does.
    ft = cut_lineage(report(build_feature_table(spark, sf_dir)))
    return K.minmax_scaled_long(ft, _NUM)


@register("user_one_hot", with_views("""
SELECT msno, 'msno@' || CAST(dense_rank() OVER (ORDER BY msno) AS VARCHAR) AS feature, CAST(1.0 AS DOUBLE) AS value
FROM train""", "train"), "K2 over user ids")
def q_user_one_hot(spark, sf_dir):
    ids = Tables(spark, sf_dir).train.selectExpr("msno AS row_id", "msno")
    return K.one_hot_long(ids, ["msno"], key="row_id").withColumnRenamed("row_id", "msno")


@register("order_label_encoded", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderkey % 99991) - 1 AS INT) AS code FROM orders""",
          "K1 over many categories")
def q_order_label_encoded(spark, sf_dir):
    od = Tables(spark, sf_dir).raw("orders").selectExpr("o_orderkey", "o_orderkey % 99991 AS category")
    return K.label_encode(od, "category", "code").select("o_orderkey", "code")

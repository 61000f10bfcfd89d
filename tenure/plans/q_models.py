"""Registered model queries (L1-L7, M7): rows-only checks but for the optimum of the regression,
which SQL can state.

The layers around the fits have oracles of their own: folds (``cv_folds``),
metrics (``split_evaluation`` and the other metric queries).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import encode as K
from tenure.operators import features as FT
from tenure.operators import intervals as I
from tenure.operators import metrics as MT
from tenure.operators import models as ML
from tenure.operators import user_effects as UE
from tenure.plans.oracle_views import with_views
from tenure.plans.q_features import FEATURE_TABLE_SQL, build_feature_table
from tenure.plans.registry import register, report
from tenure.sources.fixtures import Tables

N_FOLDS = 5
MAX_GRADIENT = 1e-4
FIRST_MODEL_MAJORITY = 1500


def _design(spark, sf_dir):
    return ML.design_matrix(build_feature_table(spark, sf_dir), FT.CATEGORICAL)


@register("rf_scores", None, "L2 L3 L4 I5 K1 K2 K6 H4")
def q_rf_scores(spark, sf_dir):
    scores, _ = ML.rf_scores(_design(spark, sf_dir))
    return scores


@register("rf_evaluation", None, "M1-M5 of the fitted forest on both splits")
def q_rf_evaluation(spark, sf_dir):
    scores, _ = ML.rf_scores(_design(spark, sf_dir))
    return MT.evaluation(scores, ["split"])


@register("importance_by_variable", None, "L7 K5 G2")
def q_importance_by_variable(spark, sf_dir):
    design = _design(spark, sf_dir)
    _, model = ML.rf_scores(design)
    return ML.importance_by_variable(ML.forest_nodes(model, spark), design.feature_names)


@register("logreg_scores", None, "L1")
def q_logreg_scores(spark, sf_dir):
    return ML.logreg_scores(_design(spark, sf_dir))


_TRAIN = ("CAST(('0x' || substr(md5(concat('42:', CAST(msno AS VARCHAR))), 1, 8)) AS BIGINT) "
          "/ CAST(4294967296.0 AS DOUBLE) < CAST(0.7 AS DOUBLE)")
_LEVELS = "\nUNION ALL\n".join(
    f"SELECT msno, '{c}@' || CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) AS VARCHAR) AS feature, 1.0 AS x FROM ft"
    for c in FT.CATEGORICAL)
_NUMBERS = "\nUNION ALL\n".join(
    f"SELECT msno, '{c}' AS feature, CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN 0.0 "
    f"WHEN isinf(CAST({c} AS DOUBLE)) THEN 5.0 ELSE CAST({c} AS DOUBLE) END AS v FROM ft"
    for c in K.numeric_columns(FT.feature_columns(), FT.CATEGORICAL))


@register("logreg_optimality", f"""
WITH ft AS MATERIALIZED (SELECT * FROM ({FEATURE_TABLE_SQL}) q),
lg AS MATERIALIZED ({_NUMBERS}),
st AS (SELECT feature, min(v) AS mn, max(v) AS mx FROM lg GROUP BY feature),
x AS ({_LEVELS}
UNION ALL SELECT msno, lg.feature, CASE WHEN mx = mn THEN 0.0 ELSE (v - mn) / (mx - mn) END FROM lg JOIN st ON lg.feature = st.feature
UNION ALL SELECT msno, 'intercept', 1.0 FROM ft)
SELECT feature, round(CAST(sum(CASE WHEN is_churn = 1 AND {_TRAIN} THEN x ELSE 0 END) AS DOUBLE), 6) AS observed,
       true AS optimal
FROM (SELECT x.*, ft.is_churn FROM x JOIN ft USING (msno)) j GROUP BY feature""", "L1: gradient of the penalised loss")
def q_logreg_optimality(spark, sf_dir):
    # Fitted on the reported (6-place) feature table, as the oracle sums it.
    design = ML.design_matrix(report(build_feature_table(spark, sf_dir)), FT.CATEGORICAL)
    return ML.logreg_optimality(design).select("feature", "observed", (F.abs("gradient") < MAX_GRADIENT).alias("optimal"))


_USER_NUM = ["payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew"]


def _user_rows(spark, sf_dir):
    """Every transaction with its own columns and its user: the first model's design over all users."""
    tx = Tables(spark, sf_dir).tx.withColumn("tx_key", F.concat_ws("-", "seq1", "seq2"))
    return UE.scaled_rows(tx, _USER_NUM, "tx_key", "msno", "is_cancel")


_USER_CTES = [
    ("tk", "SELECT *, CAST(seq1 AS VARCHAR) || '-' || CAST(seq2 AS VARCHAR) AS tx_key FROM tx"),
    ("lg", "\nUNION ALL\n".join(f"SELECT tx_key, is_cancel, '{n}' AS feature, CAST({n} AS DOUBLE) AS v, CAST({i} AS BIGINT) AS position FROM tk"
                               for i, n in enumerate(_USER_NUM))),
    ("st", "SELECT feature, min(v) AS mn, max(v) AS mx FROM lg GROUP BY feature"),
    ("x", f"""SELECT tx_key, is_cancel, lg.feature, position, CASE WHEN mx = mn THEN 0.0 ELSE (v - mn) / (mx - mn) END AS value
FROM lg JOIN st ON lg.feature = st.feature
UNION ALL SELECT tx_key, is_cancel, 'msno@' || CAST(dense_rank() OVER (ORDER BY msno) AS VARCHAR),
  dense_rank() OVER (ORDER BY msno) + {len(_USER_NUM) - 1}, 1.0 FROM tk"""),
]


@register("user_design", with_views("SELECT tx_key, position, feature, round(value, 6) AS value FROM x WHERE value <> 0",
                                    "tx", extra=_USER_CTES), "K2 K3 H4: user ids as sparse columns")
def q_user_design(spark, sf_dir):
    return UE.sparse_design(_user_rows(spark, sf_dir), _USER_NUM, "tx_key", "msno")


@register("user_logreg_optimality", with_views(f"""
SELECT feature, round(CAST(sum(CASE WHEN is_cancel = 1 AND {_TRAIN.replace("msno", "tx_key")} THEN value ELSE 0 END) AS DOUBLE), 3) AS observed,
       true AS optimal
FROM (SELECT tx_key, is_cancel, feature, value FROM x UNION ALL SELECT tx_key, is_cancel, 'intercept', 1.0 FROM tk) a
GROUP BY feature""", "tx", extra=_USER_CTES), "L1 K2 H4: regression over user ids, gradient of every column")
def q_user_logreg_optimality(spark, sf_dir):
    rows = _user_rows(spark, sf_dir)
    model = UE.fit(rows, _USER_NUM, "tx_key", "msno", "is_cancel")
    return UE.optimality(model, rows, _USER_NUM, "msno").select(
        "feature", F.round("observed", 3).alias("observed"), (F.abs("gradient") < MAX_GRADIENT).alias("optimal"))


@register("rf_grid", None, "L5 M7")
def q_rf_grid(spark, sf_dir):
    return ML.grid_search(_design(spark, sf_dir)).scores


@register("rf_grid_refit", None, "L5 refit on all training rows, both splits scored")
def q_rf_grid_refit(spark, sf_dir):
    return ML.grid_search(_design(spark, sf_dir)).refit_scores


@register("first_model_scores", None, "J5 I2 L2 L3: the first model")
def q_first_model_scores(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = I.first_model_rows(t.tx_ev, t.user_logs, carry=["payment_plan_days"])
    return ML.first_model(rows, t.train, FIRST_MODEL_MAJORITY)


@register("ada_rf", None, "L6")
def q_ada_rf(spark, sf_dir):
    return ML.ada_boost_rf(_design(spark, sf_dir))


@register("cv_folds", with_views(f"""
SELECT msno, is_churn, CAST((row_number() OVER (PARTITION BY is_churn
         ORDER BY md5(concat('42:', CAST(msno AS VARCHAR)))) - 1) % {N_FOLDS} AS INT) AS fold
FROM train""", "train"), "L5 folds")
def q_cv_folds(spark, sf_dir):
    return ML.stratified_folds(Tables(spark, sf_dir).train, N_FOLDS)

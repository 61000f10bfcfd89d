"""Registered evaluation queries on the deterministic ``scored`` view (M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import metrics as MT
from tenure.operators.sampling import hash_int, train_test_split
from tenure.plans.oracle_views import with_views
from tenure.plans.registry import REGISTRY, register, report
from tenure.session import stage_path
from tenure.sources import io
from tenure.sources.fixtures import Tables

N_FOLDS = 5
_S = ("s", "SELECT msno, is_churn, p1, CAST(p1 > 0.5 AS INT) AS prediction FROM scored")
_COUNTS = ("c", """SELECT count(*) FILTER (WHERE is_churn = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE is_churn = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE is_churn = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE is_churn = 0 AND prediction = 0) AS tn FROM s""")


def _scored(spark, sf_dir):
    return MT.with_prediction(Tables(spark, sf_dir).scored)


@register("accuracy", with_views("""
SELECT round(avg(CASE WHEN is_churn = prediction THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6)
  AS accuracy FROM s""", "scored", extra=[_S]), "M1")
def q_accuracy(spark, sf_dir):
    return MT.accuracy(_scored(spark, sf_dir))


@register("confusion", with_views("""
SELECT l.label, p.prediction, count(s.msno) AS n
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
LEFT JOIN s ON s.is_churn = l.label AND s.prediction = p.prediction
GROUP BY l.label, p.prediction""", "scored", extra=[_S]), "M2")
def q_confusion(spark, sf_dir):
    return MT.confusion(_scored(spark, sf_dir))


_PCLIP = "least(greatest(p1, 1e-15), 1 - 1e-15)"


@register("log_loss", with_views(f"""
SELECT round(avg(-(CAST(is_churn AS DOUBLE) * ln({_PCLIP})
                   + (1 - CAST(is_churn AS DOUBLE)) * ln(1 - {_PCLIP}))), 6) AS log_loss
FROM s""", "scored", extra=[_S]), "M3")
def q_log_loss(spark, sf_dir):
    return MT.log_loss(_scored(spark, sf_dir))


def _prf_sql(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p = f"coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fp}, 0), 0.0)"
    r = f"coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fn}, 0), 0.0)"
    f = f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0.0)"
    return p, r, f


_P1, _R1, _F1 = _prf_sql("tp", "fp", "fn")
_P0, _R0, _F0 = _prf_sql("tn", "fn", "fp")


@register("class_report", with_views(f"""
SELECT class_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support FROM (
  SELECT '0' AS class_label, {_P0} AS precision, {_R0} AS recall, {_F0} AS f1_score, tn + fp AS support FROM c
  UNION ALL SELECT '1', {_P1}, {_R1}, {_F1}, tp + fn FROM c
  UNION ALL SELECT 'macro avg', (({_P0}) + ({_P1})) / 2, (({_R0}) + ({_R1})) / 2, (({_F0}) + ({_F1})) / 2,
                   tp + fn + tn + fp FROM c
  UNION ALL SELECT 'weighted avg',
     (({_P0}) * (tn + fp) + ({_P1}) * (tp + fn)) / CAST(tp + fn + tn + fp AS DOUBLE),
     (({_R0}) * (tn + fp) + ({_R1}) * (tp + fn)) / CAST(tp + fn + tn + fp AS DOUBLE),
     (({_F0}) * (tn + fp) + ({_F1}) * (tp + fn)) / CAST(tp + fn + tn + fp AS DOUBLE),
     tp + fn + tn + fp FROM c) r""", "scored", extra=[_S, _COUNTS]), "M4")
def q_class_report(spark, sf_dir):
    return MT.class_report(_scored(spark, sf_dir))


_SC = ("sc", """SELECT p1 AS score, count(*) FILTER (WHERE is_churn = 1) AS n_pos,
       count(*) FILTER (WHERE is_churn = 0) AS n_neg FROM scored GROUP BY p1""")


@register("roc_auc", with_views("""
SELECT round(sum(CAST(n_pos AS DOUBLE) * ((cum - n_neg) + n_neg / 2.0))
             / CAST(sum(n_pos) * sum(n_neg) AS DOUBLE), 6) AS roc_auc
FROM (SELECT *, CAST(sum(n_neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum
      FROM sc) c""", "scored", extra=[_SC]), "M5")
def q_roc_auc(spark, sf_dir):
    return MT.roc_auc(Tables(spark, sf_dir).scored)


@register("roc_points", with_views("""
SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, CAST(NULL AS DOUBLE) AS threshold
UNION ALL
SELECT round(CAST(cn AS DOUBLE) / (SELECT sum(n_neg) FROM sc), 6),
       round(CAST(cp AS DOUBLE) / (SELECT sum(n_pos) FROM sc), 6), round(score, 6)
FROM (SELECT score, sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM sc) c""",
    "scored", extra=[_SC]), "M6")
def q_roc_points(spark, sf_dir):
    return MT.roc_points(Tables(spark, sf_dir).scored)


_FOLD_SQL = ("CAST(('0x' || substr(md5(concat('42:', CAST(msno AS VARCHAR))), 1, 8)) AS BIGINT) "
             f"% {N_FOLDS}")


@register("cv_scores", with_views(f"""
SELECT c.fold, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1, round(r, 6) AS recall,
       round(acc, 6) AS accuracy, round(nll, 6) AS neg_log_loss, round(auc, 6) AS roc_auc
FROM (SELECT fold,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS p,
        coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS r,
        CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS acc
      FROM (SELECT fold, count(*) FILTER (WHERE is_churn = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE is_churn = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE is_churn = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE is_churn = 0 AND prediction = 0) AS tn FROM f GROUP BY fold) q) c
JOIN (SELECT fold, avg(CAST(is_churn AS DOUBLE) * ln({_PCLIP})
                       + (1 - CAST(is_churn AS DOUBLE)) * ln(1 - {_PCLIP})) AS nll
      FROM f GROUP BY fold) l ON l.fold = c.fold
JOIN (SELECT fold, sum(CAST(n_pos AS DOUBLE) * ((cum - n_neg) + n_neg / 2.0))
                   / CAST(sum(n_pos) * sum(n_neg) AS DOUBLE) AS auc
      FROM (SELECT *, CAST(sum(n_neg) OVER (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING)
                      AS DOUBLE) AS cum
            FROM (SELECT fold, p1 AS score, count(*) FILTER (WHERE is_churn = 1) AS n_pos,
                    count(*) FILTER (WHERE is_churn = 0) AS n_neg FROM f GROUP BY fold, p1) g) h
      GROUP BY fold) a ON a.fold = c.fold""", "scored", extra=[
    _S, ("f", f"SELECT *, {_FOLD_SQL} AS fold FROM s")]), "M7")
def q_cv_scores(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("fold", hash_int("msno", 42) % N_FOLDS)
    return MT.cv_scores(s, ["fold"])


def _split_eval_sql() -> str:
    """Long-form metrics per split, from the same fragments as the single queries."""
    parts = [
        """SELECT split, 'accuracy' AS item, avg(CASE WHEN is_churn = prediction THEN CAST(1 AS DOUBLE)
                ELSE CAST(0 AS DOUBLE) END) AS value FROM sp GROUP BY split""",
        f"""SELECT split, 'log_loss', avg(-(CAST(is_churn AS DOUBLE) * ln({_PCLIP})
                + (1 - CAST(is_churn AS DOUBLE)) * ln(1 - {_PCLIP}))) FROM sp GROUP BY split""",
        """SELECT split, 'roc_auc', sum(CAST(n_pos AS DOUBLE) * ((cum - n_neg) + n_neg / 2.0))
                / CAST(sum(n_pos) * sum(n_neg) AS DOUBLE)
           FROM (SELECT *, CAST(sum(n_neg) OVER (PARTITION BY split ORDER BY score ROWS UNBOUNDED PRECEDING)
                           AS DOUBLE) AS cum
                 FROM (SELECT split, p1 AS score, count(*) FILTER (WHERE is_churn = 1) AS n_pos,
                         count(*) FILTER (WHERE is_churn = 0) AS n_neg FROM sp GROUP BY split, p1) g) h GROUP BY split"""]
    for cell, name in (("tn", "0/0"), ("fp", "0/1"), ("fn", "1/0"), ("tp", "1/1")):
        parts.append(f"SELECT split, 'confusion {name}', CAST({cell} AS DOUBLE) FROM sc")
    report = {"0": (_P0, _R0, _F0, "tn + fp"), "1": (_P1, _R1, _F1, "tp + fn")}
    for i, m in enumerate(("precision", "recall", "f1_score")):
        a, b = report["0"][i], report["1"][i]
        for cls in report:
            parts.append(f"SELECT split, '{m} {cls}', {report[cls][i]} FROM sc")
        parts.append(f"SELECT split, '{m} macro avg', (({a}) + ({b})) / 2 FROM sc")
        parts.append(f"SELECT split, '{m} weighted avg', (({a}) * (tn + fp) + ({b}) * (tp + fn)) "
                     "/ CAST(tp + fn + tn + fp AS DOUBLE) FROM sc")
    for cls, n in (("0", "tn + fp"), ("1", "tp + fn"), ("macro avg", "tp + fn + tn + fp"),
                   ("weighted avg", "tp + fn + tn + fp")):
        parts.append(f"SELECT split, 'support {cls}', CAST({n} AS DOUBLE) FROM sc")
    union = "\nUNION ALL ".join(parts)
    return with_views(f"SELECT split, item, round(value, 6) AS value FROM ({union}) u", "scored", extra=[
        _S, ("sp", """SELECT *, CASE WHEN CAST(('0x' || substr(md5(concat('42:', CAST(msno AS VARCHAR))), 1, 8)) AS BIGINT)
                / CAST(4294967296.0 AS DOUBLE) < CAST(0.7 AS DOUBLE) THEN 'train' ELSE 'test' END AS split FROM s"""),
        ("sc", _COUNTS[1].replace("SELECT count", "SELECT split, count", 1).replace("FROM s", "FROM sp GROUP BY split"))])


@register("split_evaluation", _split_eval_sql(), "M1-M5 per split")
def q_split_evaluation(spark, sf_dir):
    return MT.evaluation(train_test_split(_scored(spark, sf_dir), 0.3, seed=42), ["split"])


# A score per line item: many more distinct scores than users.
_LINES = ("lines", """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_churn,
       CAST((l_orderkey * 31 + l_linenumber) * 7919 % 999983 AS DOUBLE) / 999983 AS p1 FROM lineitem""")
_LINE_SC = ("sc", _SC[1].replace("FROM scored", "FROM lines"))


def _line_scores(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem")
    code = (F.col("l_orderkey") * 31 + F.col("l_linenumber")) * 7919 % 999983
    return li.select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_churn"),
                     (code.cast("double") / 999983).alias("p1"))


@register("roc_auc_lines", f"""WITH lines AS ({_LINES[1]}), sc AS ({_LINE_SC[1]})
SELECT round(sum(CAST(n_pos AS DOUBLE) * ((cum - n_neg) + n_neg / 2.0))
             / CAST(sum(n_pos) * sum(n_neg) AS DOUBLE), 6) AS roc_auc
FROM (SELECT *, CAST(sum(n_neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum
      FROM sc) c""", "M5 over line items")
def q_roc_auc_lines(spark, sf_dir):
    return MT.roc_auc(_line_scores(spark, sf_dir))


@register("roc_points_lines", f"""WITH lines AS ({_LINES[1]}), sc AS ({_LINE_SC[1]})
SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, CAST(NULL AS DOUBLE) AS threshold
UNION ALL
SELECT round(CAST(cn AS DOUBLE) / (SELECT sum(n_neg) FROM sc), 6),
       round(CAST(cp AS DOUBLE) / (SELECT sum(n_pos) FROM sc), 6), round(score, 6)
FROM (SELECT score, sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM sc) c""", "M6 over line items")
def q_roc_points_lines(spark, sf_dir):
    return MT.roc_points(_line_scores(spark, sf_dir))


def _curve_sql(lead: str, views: tuple = ()) -> str:
    """The curve without the points between two equal steps."""
    down = "OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
    return with_views(f"""
SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, CAST(NULL AS DOUBLE) AS threshold
UNION ALL
SELECT round(CAST(cn AS DOUBLE) / (SELECT sum(n_neg) FROM sc), 6),
       round(CAST(cp AS DOUBLE) / (SELECT sum(n_pos) FROM sc), 6), round(score, 6)
FROM (SELECT *, sum(n_pos) {down} AS cp, sum(n_neg) {down} AS cn, row_number() OVER (ORDER BY score DESC) AS place,
             lead(n_pos) OVER (ORDER BY score DESC) AS next_pos, lead(n_neg) OVER (ORDER BY score DESC) AS next_neg FROM sc) c
WHERE place = 1 OR next_pos IS NULL OR next_pos <> n_pos OR next_neg <> n_neg""", *views, extra=lead)


@register("roc_curve", _curve_sql([_SC], ("scored",)), "M6, collinear points dropped")
def q_roc_curve(spark, sf_dir):
    return MT.roc_points(Tables(spark, sf_dir).scored, drop_collinear=True)


@register("roc_curve_lines", _curve_sql([_LINES, _LINE_SC]), "M6 over line items, collinear points dropped")
def q_roc_curve_lines(spark, sf_dir):
    return MT.roc_points(_line_scores(spark, sf_dir), drop_collinear=True)


@register("cv_table_roundtrip", REGISTRY["cv_scores"].sql, "A6: a result table written as CSV and read back")
def q_cv_table_roundtrip(spark, sf_dir):
    return io.result_roundtrip(report(q_cv_scores(spark, sf_dir)), stage_path(spark, "cv_table"))

"""Classifier evaluation as aggregations over a scored table (M1-M7).

Input: rows (label, class-1 probability[, prediction][, group keys]).
Counting metrics are one grouped aggregation.  ROC AUC and ROC points need
a global order of scores: scores are first collapsed to one row per distinct
score (partial aggregation), then running sums come from ``prefix_sums``
over ranges of scores -- never a whole-table ``Window.orderBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.windows import next_values, prefix_sums

LOG_LOSS_EPS = 1e-15


def with_prediction(scored: DataFrame, prob: str = "p1", threshold: float = 0.5,
                    out: str = "prediction") -> DataFrame:
    """The class of the larger probability; an exact tie is class 0."""
    return scored.withColumn(out, (F.col(prob) > F.lit(threshold)).cast("int"))


def _counts(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]


def accuracy(scored: DataFrame, label: str = "is_churn", pred: str = "prediction",
             group_cols: list[str] | None = None) -> DataFrame:
    """M1."""
    g = scored.groupBy(*(group_cols or []))
    return g.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(scored: DataFrame, label: str = "is_churn", pred: str = "prediction",
              group_cols: list[str] | None = None) -> DataFrame:
    """M2: the full 2x2 grid (label, prediction, n) per group, empty cells as 0."""
    g = list(group_cols or [])
    c = scored.groupBy(*g).agg(*_counts(label, pred))
    return c.selectExpr(*g, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, prediction, n)")


def _clipped(prob: str, eps: float = LOG_LOSS_EPS) -> Column:
    return F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1.0 - eps))


def log_loss(scored: DataFrame, label: str = "is_churn", prob: str = "p1",
             group_cols: list[str] | None = None) -> DataFrame:
    """M3: mean negative log-likelihood, probabilities clipped to [1e-15, 1-1e-15]."""
    p = _clipped(prob)
    y = F.col(label).cast("double")
    ll = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return scored.groupBy(*(group_cols or [])).agg(F.avg(ll).alias("log_loss"))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return prec, rec, f1


def class_report(scored: DataFrame, label: str = "is_churn", pred: str = "prediction",
                 group_cols: list[str] | None = None) -> DataFrame:
    """M4: precision / recall / F1 / support per class, plus macro and weighted averages, per group.

    A zero denominator gives 0 (scikit-learn's default with a warning).
    """
    g = list(group_cols or [])
    c = scored.groupBy(*g).agg(*_counts(label, pred))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1, f1 = _prf(tp, fp, fn)          # class 1
    p0, r0, f0 = _prf(tn, fn, fp)          # class 0 (roles swapped)
    s1, s0 = tp + fn, tn + fp
    tot = (s0 + s1).cast("double")
    wide = c.select(
        *g, p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"),
        ((p0 + p1) / 2).alias("pm"), ((r0 + r1) / 2).alias("rm"), ((f0 + f1) / 2).alias("fm"),
        F.try_divide(p0 * s0 + p1 * s1, tot).alias("pw"), F.try_divide(r0 * s0 + r1 * s1, tot).alias("rw"),
        F.try_divide(f0 * s0 + f1 * s1, tot).alias("fw"), (s0 + s1).alias("st"))
    return wide.selectExpr(
        *g, "stack(4, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, 'macro avg', pm, rm, fm, st, "
        "'weighted avg', pw, rw, fw, st) AS (class_label, precision, recall, f1_score, support)")


def score_counts(scored: DataFrame, label: str = "is_churn", prob: str = "p1",
                 group_cols: list[str] | None = None) -> DataFrame:
    """One row per (group, distinct score) with positive and negative counts."""
    return scored.groupBy(*(group_cols or []), F.col(prob).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def roc_auc(scored: DataFrame, label: str = "is_churn", prob: str = "p1",
            group_cols: list[str] | None = None) -> DataFrame:
    """M5: AUC with tied scores counted half (rank-sum with average ranks).

    AUC = sum over scores of n_pos(s) * (negatives below s + n_neg(s)/2) / (P * N).
    """
    g = list(group_cols or [])
    sc = prefix_sums(score_counts(scored, label, prob, g), ["score"], ["n_neg"], group_cols=g)
    contrib = F.col("n_pos") * ((F.col("n_neg_cum") - F.col("n_neg")) + F.col("n_neg") / 2.0)
    agg = sc.groupBy(*g).agg(F.sum(contrib).alias("_num"), F.sum("n_pos").alias("_p"),
                             F.sum("n_neg").alias("_n"))
    return agg.select(*g, F.try_divide(F.col("_num"), (F.col("_p") * F.col("_n")).cast("double"))
                      .alias("roc_auc"))


def roc_points(scored: DataFrame, label: str = "is_churn", prob: str = "p1",
               group_cols: list[str] | None = None, drop_collinear: bool = False) -> DataFrame:
    """M6: (fpr, tpr, threshold) at every distinct score, descending, plus the (0, 0) start, per group.

    With ``drop_collinear`` (scikit-learn's default) a point goes if the step to it and the step to the
    next are the same: it lies on the line between its neighbours.  A group's first and last point stay.
    The start point's threshold is NULL.
    """
    g = list(group_cols or [])
    sc = score_counts(scored, label, prob, g).withColumn("neg_score", -F.col("score"))
    if drop_collinear:
        sc = next_values(sc, "neg_score", ["n_pos", "n_neg"], group_cols=g)
    cum = prefix_sums(sc, ["neg_score"], ["n_pos", "n_neg"], group_cols=g)   # counts with score >= s
    if drop_collinear:
        same_step = (F.col("n_pos") == F.col("next_n_pos")) & (F.col("n_neg") == F.col("next_n_neg"))
        first = (F.col("n_pos_cum") == F.col("n_pos")) & (F.col("n_neg_cum") == F.col("n_neg"))
        cum = cum.where(first | ~F.coalesce(same_step, F.lit(False)))
    totals = sc.groupBy(*g).agg(F.sum("n_pos").alias("_p"), F.sum("n_neg").alias("_n"))
    if g:
        of = totals.select(*[F.col(c).alias(f"_t_{c}") for c in g], "_p", "_n")
        same = F.lit(True)
        for c in g:
            same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        cum, tot_p, tot_n = cum.join(of, same), F.col("_p"), F.col("_n")
    else:
        tot_p, tot_n = totals.select("_p").scalar(), totals.select("_n").scalar()
    pts = cum.select(*g, F.try_divide(F.col("n_neg_cum").cast("double"), tot_n.cast("double")).alias("fpr"),
                     F.try_divide(F.col("n_pos_cum").cast("double"), tot_p.cast("double")).alias("tpr"),
                     F.col("score").alias("threshold"))
    starts = totals if g else scored.sparkSession.range(1)
    start = starts.select(*g, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                          F.lit(None).cast("double").alias("threshold"))
    return start.unionByName(pts)


def cv_scores(scored: DataFrame, group_cols: list[str], label: str = "is_churn", prob: str = "p1",
              pred: str = "prediction") -> DataFrame:
    """M7: neg-log-loss, F1, accuracy, recall and ROC AUC per group (e.g. params x fold)."""
    c = scored.groupBy(*group_cols).agg(*_counts(label, pred))
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    counts = c.select(*group_cols, f1.alias("f1"), r.alias("recall"),
                      ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
                      .alias("accuracy"))
    ll = log_loss(scored, label, prob, group_cols).withColumn("neg_log_loss", -F.col("log_loss")) \
        .drop("log_loss")
    auc = roc_auc(scored, label, prob, group_cols)
    return counts.join(ll, group_cols).join(auc, group_cols)


def evaluation(scored: DataFrame, group_cols: list[str], label: str = "is_churn", prob: str = "p1",
               pred: str = "prediction") -> DataFrame:
    """M1-M5 per group (e.g. train and test split) in long form: (groups, item, value).

    Items: accuracy, log_loss, roc_auc, ``confusion l/p`` and ``precision|recall|f1_score|support class``.
    """
    g = list(group_cols)

    def long(df: DataFrame, item: Column, value: str) -> DataFrame:
        return df.select(*g, item.alias("item"), F.col(value).cast("double").alias("value"))

    out = long(accuracy(scored, label, pred, g), F.lit("accuracy"), "accuracy")
    out = out.unionByName(long(log_loss(scored, label, prob, g), F.lit("log_loss"), "log_loss"))
    out = out.unionByName(long(roc_auc(scored, label, prob, g), F.lit("roc_auc"), "roc_auc"))
    cells = confusion(scored, label, pred, g)
    out = out.unionByName(long(cells, F.format_string("confusion %d/%d", "label", "prediction"), "n"))
    report = class_report(scored, label, pred, g)
    for m in ("precision", "recall", "f1_score", "support"):
        out = out.unionByName(long(report, F.concat(F.lit(f"{m} "), F.col("class_label")), m))
    return out

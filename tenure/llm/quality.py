"""Quality rules with risk-controlled thresholds (operator 6).

Base statistics come from whole texts: words are runs of anything but ASCII
white space.  Beyond the base rule (too few words, or mostly repeated
three-word windows) a document is judged by scores whose cutoffs are chosen on
labelled documents, separately in every stratum (language):

* Every score is an integer, higher is worse; a rule rejects a document whose
  score is over the rule's cutoff.  How harsh a score is follows from all of
  the stratum's documents: the share that have less of it, in millionths (exact,
  by a histogram).  A document's harshness is the largest of its scores'.  So one
  number cuts all rules of a stratum at once, and cutting it lower rejects more.
* For each cut the labelled good documents that it would reject are counted.
  A cut is certified when, were the true rate of false rejections above
  ``max_false_rejection``, seeing so few would have exact binomial
  probability of at most the stratum's share of ``error`` (the same as the
  Clopper-Pearson upper bound being below the rate).  The error is shared over
  strata (Bonferroni); the cuts of a stratum are tested from the most lenient to
  the strictest and the first failure ends it, which needs no further
  correction.  What is harsh is found without looking at labels.
* Of the certified cuts the one that removes most bad minus good labelled
  documents is taken (ties: the more lenient); each rule's cutoff is the largest
  score that it lets stand.  Without a certified, useful cut nothing is rejected.

So with probability 1 - ``error``, in no stratum are more than
``max_false_rejection`` of the good documents rejected by these rules.  A
stratum needs some 60 good labels if it is the only one, 86 if it is one of four.

Defined results: a null or empty text has no words (and fails the base rule); a
null stratum is a stratum of its own; labels without a document, or without a
value, are ignored; a document with several label rows, and each of repeated
rows, counts once for each; ties in a score stand or fall together; without
labels no rule rejects anything, and an empty table gives no rows; a very long
text is counted whole; columns whose names clash with a statistic's are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import CONTINUATION, append_columns, fresh, small_side
from tenure.session import stage_shared

MIN_WORDS = 50
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05
TOP = 2000          # scores are integers from 0 to TOP
HARSHEST = 1_000_000

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_SHOUT = bytes(b for b in range(256) if b not in b"!?")

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_shout"]


def statistics(b: bytes | None) -> tuple[int, ...]:
    """STATS and MORE of one text."""
    b = b or b""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(_BLANKS)]
    return (len(words), len(b.translate(None, _BLANKS + CONTINUATION)),
            len(b) - len(b.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(b.translate(None, _NOT_UPPER)),
            len(b.translate(None, _NOT_SHOUT)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:]))) == len(words) - 2:
        return 0
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * (ids.max() + 1) + ids[2:]
    _, which, counts = np.unique(triples, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift:len(words) - 2 + shift] |= twice
    return int(inside.sum())


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, dict]:
    """``docs`` with one column per statistic, and the names these columns got."""
    names = dict(zip(STATS + MORE, fresh(docs, *STATS, *MORE)))

    def make():
        return lambda texts: list(zip(*map(statistics, texts))) or [[]] * len(names)

    return append_columns(docs, text_col, [(n, T.LongType()) for n in names.values()], make, keep_text), names


def base_failed(c: dict[str, str]) -> Column:
    return (F.col(c["n_words"]) < MIN_WORDS) | (100 * F.col(c["n_repeat_words"]) > 50 * F.col(c["n_words"]))


def scores(c: dict[str, str]) -> dict[str, Column]:
    """Rule name -> integer score, higher is worse."""
    def per(part: str, whole: str, scale: int) -> Column:
        share = F.floor(F.lit(scale) * F.col(c[part]) / F.greatest(F.col(c[whole]), F.lit(1)))
        return F.least(share, F.lit(TOP)).cast("int")
    return {"symbols": per("n_symbols", "n_words", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000),
            "repeats": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 50),
            "upper": per("n_upper", "word_chars", 1000), "shout": per("n_shout", "n_words", 1000)}


RULES = ["symbols", "dup_lines", "repeats", "word_length", "upper", "shout"]


def tail_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function I(1 - p; n - k, k + 1), by its
    continued fraction, so that its time does not grow with k."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):       # the fraction converges fast on this side
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 1_000_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * out / a)


def choose_cutoff(score: np.ndarray, good: np.ndarray, bad: np.ndarray, rate: float, error: float) -> int | None:
    """The cutoff for one stratum, from a histogram of scores of good and bad documents: scores over it are rejected."""
    n, best, cutoff, k, caught = int(good.sum()), 0, None, 0, 0
    for i in np.argsort(-score):            # from the most lenient cutoff on
        k, caught = k + int(good[i]), caught + int(bad[i])
        if not n or tail_at_most(k, n, rate) > error:
            break
        if caught - k > best:
            best, cutoff = caught - k, int(score[i]) - 1
    return cutoff


def fit_cutoffs(stats: DataFrame, c: dict[str, str], labels: DataFrame, stratum: Column, id_col: str = "doc_id",
                label_id_col: str = "doc_id", label_col: str = "quality",
                max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """One row per stratum with a certified cut: a cutoff per rule, null where the rule rejects nothing.

    ``stats`` has the statistics' columns (text not needed).  Documents that
    fail the base rule take no part: the method does not decide on them.
    """
    judged = stats.where(~base_failed(c)).select(
        F.col(f"`{id_col}`").alias("id"), stratum.alias("stratum"), F.array(*[scores(c)[r] for r in RULES]).alias("scores"))
    marks = labels.select(F.col(f"`{label_id_col}`").alias("id"), F.col(f"`{label_col}`").alias("good")).where(
        "id is not null and good in (0, 1)")
    # A histogram, at most TOP + 1 rows for each stratum and rule, and in each the share of documents below a score.
    counts = judged.select("stratum", F.posexplode("scores").alias("rule", "score")).groupBy("stratum", "rule", "score").agg(
        F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("stratum", "rule")
    below = F.coalesce(F.sum("n").over(every.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    harsh = stage_shared(counts.select("stratum", "rule", "score", F.floor(
        F.lit(HARSHEST) * below / F.sum("n").over(every)).cast("bigint").alias("harsh")), "harshness")
    # Labelled documents, equal scores together, with the largest harshness of their scores.
    marked = judged.join(marks, "id").groupBy("stratum", "scores").agg(
        F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad"))
    histogram = stage_shared(marked.select("*", F.posexplode("scores").alias("rule", "score")).join(
        small_side(harsh), ["stratum", "rule", "score"]).groupBy("stratum", "scores").agg(
        F.max("harsh").alias("harsh"), F.first("good").alias("good"), F.first("bad").alias("bad")).groupBy("stratum", "harsh").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")), "label_scores")
    level = error / max(1, histogram.select("stratum").distinct().count())

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        # As many rows as harshnesses differ: at most TOP + 1 for each rule.
        cutoff = choose_cutoff(group["harsh"].to_numpy(), group["good"].to_numpy(), group["bad"].to_numpy(), max_false_rejection, level)
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "cut": pd.array([cutoff], dtype="Int64")})

    chosen = histogram.groupBy("stratum").applyInPandas(choose, "stratum string, cut bigint")
    over = harsh.join(chosen, "stratum").where("harsh > cut").groupBy("stratum", "rule").agg((F.min("score") - 1).alias("cutoff"))
    return stage_shared(over.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cutoff_{r}") for k, r in enumerate(RULES)]),
        "cutoffs")


def stratum_of(stratum_col: str) -> Column:
    """Null is a stratum of its own, apart from every text value."""
    c = F.col(f"`{stratum_col}`").cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c))


def verdict(stats: DataFrame, c: dict[str, str], cutoffs: DataFrame, stratum: Column, name: str) -> DataFrame:
    """``stats`` with the boolean column ``name``: false if the base rule or any certified cutoff rejects."""
    [key, *limits] = fresh(stats, "stratum", *[f"cutoff_{r}" for r in RULES])
    limit = cutoffs.select(F.col("stratum").alias(key),
                           *[F.col(f"cutoff_{r}").alias(n) for r, n in zip(RULES, limits)])
    joined = stats.withColumn(key, stratum).join(limit, key, "left")
    over = F.lit(False)
    for r, n in zip(RULES, limits):
        over = over | F.coalesce(scores(c)[r] > F.col(n), F.lit(False))
    return joined.withColumn(name, ~base_failed(c) & ~over).drop(key, *limits)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str = "lang", **options) -> DataFrame:
    """One row per document: the base statistics, ``base_failed`` and ``kept``.
    Statistics are computed once, and written: both the fit and the verdict read them."""
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), stratum_of(stratum_col).alias("stratum_of_doc"),
                         F.col(f"`{text_col}`").alias("text"))
    made, c = with_statistics(narrow, "text", keep_text=False)
    stats = stage_shared(made, "quality_stats")
    cutoffs = fit_cutoffs(stats, c, labels, F.col("stratum_of_doc"), id_col, **options)
    judged = verdict(stats, c, cutoffs, F.col("stratum_of_doc"), "kept")
    return judged.select(id_col, *[F.col(c[s]).alias(s) for s in STATS], base_failed(c).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              stratum_col: str = "lang", **options) -> DataFrame:
    """``docs`` without the documents that the base rule or a certified cutoff rejects."""
    made, c = with_statistics(docs, text_col)
    made = stage_shared(made, "quality_documents")      # statistics are computed once; the fit reads these columns only
    stratum = stratum_of(stratum_col)
    cutoffs = fit_cutoffs(made, c, labels, stratum, id_col, **options)
    [kept] = fresh(made, "kept")
    return verdict(made, c, cutoffs, stratum, kept).where(F.col(kept)).select(
        *[F.col(f"`{x}`") for x in docs.columns])

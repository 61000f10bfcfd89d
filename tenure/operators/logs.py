"""Usage-log operators: D3, D5/B20, E4 (E7), E5, E6, B15-B19, and the J3 block.

The reference computes each window feature by masking the whole log table
once per user, five times over.  Here every window pair is a set of
conditional aggregates inside one ``groupBy(msno)``; E4 and E6 need a
per-user anchor (transaction bounds, last log day) joined to the log rows
first, which J3 does within one exchange on the user.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.safe import pandas_z, ratio
from tenure.sources.schemas import LOG_METRICS, PLAY_COUNTERS

# Feature-name suffix of each usage column (avg_25, z_25, z_25_3014, ...).
METRIC_SUFFIX = {"num_25": "25", "num_50": "50", "num_75": "75", "num_985": "985",
                 "num_100": "100", "num_unq": "unq", "total_secs": "secs"}

# Fixed sentinel values of the reference's z-score branches.
Z_BOUNDARY_CUR_EMPTY = 5.0
Z_BOUNDARY_HIST_EMPTY = 1.0
Z_TRAILING_HIST_EMPTY = 5.0
Z_TRAILING_HIST_EMPTY_SECS = 1.0
Z_TRAILING_CUR_EMPTY = 3.0
INF_FILL_FINAL = 5.0
INF_FILL_EARLY = 10.0

E5_PAIRS = [(30, 14, "3014"), (15, 7, "147")]
E6_PAIRS = [(30, 14, "3014"), (14, 7, "147")]


def log_averages(logs: DataFrame) -> DataFrame:
    """D3: per-user mean of the seven usage columns."""
    return logs.groupBy("msno").agg(*[F.avg(m).alias(f"avg_{METRIC_SUFFIX[m]}") for m in LOG_METRICS])


def last_login(logs: DataFrame, last_day: _dt.date) -> DataFrame:
    """D5 + B20: last log day and days from it to ``last_day``."""
    return (logs.groupBy("msno").agg(F.max("date").alias("last_login_date"))
                .withColumn("days_since_last_login", F.datediff(F.lit(last_day), "last_login_date")))


# --- z-score building blocks -------------------------------------------------

def z_aggs(tag: str, cur: Column, hist: Column) -> list[Column]:
    """Conditional counts, means and historical sample std for the seven columns."""
    out = [F.count_if(cur).alias(f"{tag}_ncur"), F.count_if(hist).alias(f"{tag}_nhist")]
    for m in LOG_METRICS:
        x = F.col(m).cast("double")
        out += [F.avg(F.when(cur, x)).alias(f"{tag}_cur_{m}"),
                F.avg(F.when(hist, x)).alias(f"{tag}_hist_{m}"),
                F.stddev_samp(F.when(hist, x)).alias(f"{tag}_std_{m}")]
    return out


def _z(tag: str, m: str, inf_value: float) -> Column:
    diff = F.col(f"{tag}_cur_{m}") - F.col(f"{tag}_hist_{m}")
    return pandas_z(diff, F.col(f"{tag}_std_{m}"), inf_value)


def _std_zero(tag: str) -> Column:
    """Whether any column's historical deviation is 0, i.e. its z is NaN or infinite before imputation."""
    out = F.lit(False)
    for m in LOG_METRICS:
        out = out | F.coalesce(F.col(f"{tag}_std_{m}") == 0, F.lit(False))
    return out


def z_boundary_cols(tag: str = "zb", inf_value: float = INF_FILL_FINAL,
                    names: str = "z_{s}", status: bool = True) -> list[Column]:
    """E4 outputs: current window empty -> 5; historical empty -> 1; else z (imputed)."""
    ncur = F.coalesce(F.col(f"{tag}_ncur"), F.lit(0))
    nhist = F.coalesce(F.col(f"{tag}_nhist"), F.lit(0))
    cols = [F.when(ncur == 0, F.lit(Z_BOUNDARY_CUR_EMPTY))
             .when(nhist == 0, F.lit(Z_BOUNDARY_HIST_EMPTY))
             .otherwise(_z(tag, m, inf_value)).alias(names.format(s=METRIC_SUFFIX[m]))
            for m in LOG_METRICS]
    if status:
        cols.append(F.when(ncur == 0, F.lit("cur_empty")).when(nhist == 0, F.lit("hist_empty"))
                     .when(nhist == 1, F.lit("std_null")).when(_std_zero(tag), F.lit("std_zero"))
                     .otherwise(F.lit("ok")).alias("status"))
    return cols


def z_trailing_cols(tag: str, suffix: str, inf_value: float = INF_FILL_FINAL,
                    status: bool = True) -> list[Column]:
    """E5 outputs: historical empty -> 5 (total_secs 1); then current empty -> 3; else z."""
    ncur = F.coalesce(F.col(f"{tag}_ncur"), F.lit(0))
    nhist = F.coalesce(F.col(f"{tag}_nhist"), F.lit(0))
    cols = []
    for m in LOG_METRICS:
        hist_empty = Z_TRAILING_HIST_EMPTY_SECS if m == "total_secs" else Z_TRAILING_HIST_EMPTY
        cols.append(F.when(nhist == 0, F.lit(hist_empty))
                     .when(ncur == 0, F.lit(Z_TRAILING_CUR_EMPTY))
                     .otherwise(_z(tag, m, inf_value)).alias(f"z_{METRIC_SUFFIX[m]}_{suffix}"))
    if status:
        cols.append(F.when(nhist == 0, F.lit("hist_empty")).when(ncur == 0, F.lit("cur_empty"))
                     .when(nhist == 1, F.lit("std_null")).when(_std_zero(tag), F.lit("std_zero"))
                     .otherwise(F.lit("ok")).alias("status"))
    return cols


def trailing_conditions(last_day: _dt.date, hist_days: int, cur_days: int) -> tuple[Column, Column]:
    """Closed windows ending at ``last_day``; the historical one contains the current one."""
    end = F.lit(last_day)
    d = F.col("date")
    hist = (d >= F.date_sub(end, hist_days)) & (d <= end)
    cur = (d >= F.date_sub(end, cur_days)) & (d <= end)
    return cur, hist


def boundary_conditions(lower_bound: bool = True) -> tuple[Column, Column]:
    """After the last transaction vs. between first and last transaction (closed)."""
    d = F.col("date")
    cur = d > F.col("last_transaction_date")
    hist = d <= F.col("last_transaction_date")
    if lower_bound:
        hist = hist & (d >= F.col("first_transaction_date"))
    return cur, hist


# --- standalone operators -----------------------------------------------------

def z_boundary(bounds: DataFrame, logs: DataFrame, lower_bound: bool = True,
               inf_value: float = INF_FILL_FINAL) -> DataFrame:
    """E4 (and E7, which is the same computation): boundary-relative z-scores per user.

    ``bounds`` = (msno, first_transaction_date, last_transaction_date), one row
    per user; every user in it gets a row (no logs -> current window empty).
    """
    cur, hist = boundary_conditions(lower_bound)
    agg = logs.join(bounds, "msno").groupBy("msno").agg(*z_aggs("zb", cur, hist))
    return bounds.select("msno").join(agg, "msno", "left").select(
        "msno", *z_boundary_cols("zb", inf_value))


def z_trailing(users: DataFrame, logs: DataFrame, last_day: _dt.date, hist_days: int,
               cur_days: int, suffix: str, inf_value: float = INF_FILL_FINAL) -> DataFrame:
    """E5: last ``cur_days`` vs last ``hist_days`` days, both ending at ``last_day``."""
    cur, hist = trailing_conditions(last_day, hist_days, cur_days)
    window = logs.filter(hist)  # only rows of the longer window are read past the scan
    agg = window.groupBy("msno").agg(*z_aggs("zt", cur, F.lit(True)))
    return users.select("msno").join(agg, "msno", "left").select(
        "msno", *z_trailing_cols("zt", suffix, inf_value))


def login_rate_aggs(pairs=E6_PAIRS) -> list[Column]:
    d, end = F.col("date"), F.col("last_login_date")
    out = []
    for h, c, sfx in pairs:
        out += [F.count_if((d >= F.date_sub(end, h)) & (d <= end)).alias(f"_lh_{sfx}"),
                F.count_if((d >= F.date_sub(end, c)) & (d <= end)).alias(f"_lc_{sfx}")]
    return out


def login_rate_cols(pairs=E6_PAIRS) -> list[Column]:
    """Rows in last h days / h - rows in last c days / c (h is the divisor even
    though the closed window spans h+1 dates)."""
    return [(F.col(f"_lh_{sfx}") / F.lit(float(h)) - F.col(f"_lc_{sfx}") / F.lit(float(c)))
            .alias(f"login_diff_{sfx}") for h, c, sfx in pairs]


def login_diff(logs: DataFrame, pairs=E6_PAIRS) -> DataFrame:
    """E6 for every user with logs; windows end at the user's own last log day."""
    ends = logs.groupBy("msno").agg(F.max("date").alias("last_login_date"))
    agg = logs.join(ends, "msno").groupBy("msno").agg(*login_rate_aggs(pairs))
    return agg.select("msno", *login_rate_cols(pairs))


# --- row-level derived columns (B15-B19) --------------------------------------

def play_total() -> Column:
    """Row total of the five counters; NULL counters count as 0 (pandas row sum)."""
    total = None
    for c in PLAY_COUNTERS:
        term = F.coalesce(F.col(c), F.lit(0))
        total = term if total is None else total + term
    return total


def repeat_columns(logs: DataFrame) -> DataFrame:
    """B16 + B17: total plays, repeated plays and their share (NULL when total is 0)."""
    return (logs.withColumn("total", play_total())
                .withColumn("repeat_songs", F.col("total") - F.col("num_unq"))
                .withColumn("repeat_percent", ratio("repeat_songs", "total")))


def normalised_counters(logs: DataFrame) -> DataFrame:
    """Each counter divided by the row total (idempotent when applied twice)."""
    total = play_total()
    return logs.select("msno", "date", *[ratio(c, total).alias(c) for c in PLAY_COUNTERS])


def listen_ratios(logs: DataFrame) -> DataFrame:
    """num_25/num_100 and num_50/num_100 per log row (NULL when num_100 is 0)."""
    return logs.select("msno", "date", ratio("num_25", "num_100").alias("ratio_25_100"),
                       ratio("num_50", "num_100").alias("ratio_50_100"))


# Fixed play-share weights of the song-length estimate.
SONG_LENGTH_WEIGHTS = {"num_25": 0.25, "num_50": 0.5, "num_75": 0.75, "num_985": 0.985, "num_100": 1.0}


def song_length(logs: DataFrame) -> DataFrame:
    """total_secs / (0.25 n25 + 0.5 n50 + 0.75 n75 + 0.985 n985 + n100)."""
    den = None
    for c, w in SONG_LENGTH_WEIGHTS.items():
        term = F.col(c) * F.lit(w)
        den = term if den is None else den + term
    return logs.select("msno", "date", ratio("total_secs", den).alias("song_length"))


def log_block(logs: DataFrame, bounds: DataFrame, last_day: _dt.date,
              e5_pairs=E5_PAIRS, e6_pairs=E6_PAIRS, inf_value: float = INF_FILL_FINAL) -> DataFrame:
    """D3, D5/B20, E4, E5 and E6 per user with logs, in one aggregation over the logs.

    E6 needs the user's last log day beside every row: a window maximum over the
    user's daily rows (at most one per calendar day).  The window, the join of the
    transaction bounds and the aggregation all need the logs by user: one exchange.
    """
    dated = logs.withColumn("last_login_date", F.max("date").over(Window.partitionBy("msno")))
    anchored = dated.join(bounds, "msno", "left")
    aggs = [F.avg(m).alias(f"avg_{METRIC_SUFFIX[m]}") for m in LOG_METRICS]
    aggs.append(F.max("last_login_date").alias("_last"))
    for h, c, sfx in e5_pairs:
        aggs += z_aggs(f"zt{sfx}", *trailing_conditions(last_day, h, c))
    aggs += z_aggs("zb", *boundary_conditions(True)) + login_rate_aggs(e6_pairs)
    block = anchored.groupBy("msno").agg(*aggs)
    out_cols = [F.col(f"avg_{METRIC_SUFFIX[m]}") for m in LOG_METRICS]
    out_cols.append(F.datediff(F.lit(last_day), "_last").alias("days_since_last_login"))
    out_cols += z_boundary_cols("zb", inf_value, status=False)
    for h, c, sfx in e5_pairs:
        out_cols += z_trailing_cols(f"zt{sfx}", sfx, inf_value, status=False)
    out_cols += login_rate_cols(e6_pairs)
    return block.select("msno", *out_cols)

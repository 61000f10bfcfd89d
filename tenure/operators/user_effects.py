"""A regression with one column a user (K2 + H4 of the first model, over millions of users).

The first model one-hot encodes the user id beside the numeric columns.  Such a
design has as many columns as there are users, so neither the columns' names
nor their weights may pass through the driver.  Here the design is a table of its
non-zeros (``sparse_design``), and a user's weight is a row of a table.

``fit`` finds the exact optimum of scikit-learn's penalised logistic loss by
Newton steps.  Each pass joins the rows with their users' weights and sums
gradient and curvature by user.  No two users share a curvature entry, so
the users are eliminated one by one (each by a division); what is left is a
system as small as the numeric column list, summed by Spark and solved on
the driver, from which every user's step follows in its own row.

A user's rows are dealt into parts of ``PART_ROWS`` (at most two tables' rows:
users + rows / PART_ROWS), so a user with a third of all rows is many keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators.encode import category_codes
from tenure.operators.models import LOGREG_C, minmax_scaled_fitted
from tenure.operators.sampling import train_test_split
from tenure.session import stage_bucketed, stage_shared

PART_ROWS = 1_000_000
TASK_ROWS = 1_000_000
MAX_STEPS = 50
TOLERANCE = 1e-7
_INTERCEPT = "intercept"


def scaled_rows(df: DataFrame, num_cols: list[str], key: str, user: str, label: str,
                test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Key, user, label (double), split and the imputed, min-max scaled numeric columns; rows without a label go."""
    rows = df.where(F.col(label).isNotNull()).select(key, user, F.col(label).cast("double").alias(label), *num_cols)
    return train_test_split(minmax_scaled_fitted(rows, num_cols), test_fraction, key, seed)


def sparse_design(rows: DataFrame, num_cols: list[str], key: str, user: str) -> DataFrame:
    """K2 + K3 + H4: the design's non-zeros as (key, position, feature, value), positions from 0: the numeric
    columns, then a column for each user in ascending order, named 'user@k' with k from 1.  A null user has none."""
    codes = category_codes(rows, user, base=1).select(F.col(user).alias("_user"), F.col("code").cast("long").alias("_code"))
    met = rows.join(codes, F.col(user) == F.col("_user"), "left")
    entries = [F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("feature"), F.col(c).alias("value"))
               for i, c in enumerate(num_cols)]
    entries.append(F.struct((F.col("_code") + (len(num_cols) - 1)).alias("position"),
                            F.concat(F.lit(f"{user}@"), F.col("_code").cast("string")).alias("feature"),
                            F.when(F.col("_code").isNotNull(), F.lit(1.0)).alias("value")))
    return met.select(key, F.inline(F.array(*entries))).where("value IS NOT NULL AND value <> 0")


@dataclass
class UserRegression:
    weights: dict[str, float]    # of the numeric columns and the intercept
    users: DataFrame             # (user, weight, observed, expected, gradient), a row per user with training rows
    totals: dict[str, dict]      # observed, expected and gradient of the numeric columns and the intercept
    steps: int


def _linear(names: list[str], values: np.ndarray) -> Column:
    out = F.lit(0.0)
    for n, v in zip(names, values):
        out = out + F.col(n) * F.lit(float(v))
    return out


def fit(rows: DataFrame, num_cols: list[str], key: str, user: str, label: str, c: float = LOGREG_C,
        part_rows: int = PART_ROWS, tolerance: float = TOLERANCE) -> UserRegression:
    """L1 over the numeric columns, an intercept and one weight a user: the minimum of
    c * sum(loss) + |weights|^2 / 2 (the intercept has no penalty) over the ``train`` rows.

    The minimum is unique: the loss is convex and every weight but the intercept is penalised.  Where a full
    step would raise the loss, it is halved.  Rows without a user have no user weight.  With no
    rows, or one class alone (the intercept then has no finite optimum), it stops after ``MAX_STEPS`` passes
    at the latest; the gradient tells.
    """
    xs = [*num_cols, _INTERCEPT]
    k = len(xs)
    train = rows.where("split = 'train'").select(F.col(user).alias("_user"), F.col(label).alias("_y"), key, *num_cols) \
                .withColumn(_INTERCEPT, F.lit(1.0))
    counts = train.groupBy("_user").agg(F.count(F.lit(1)).alias("_rows"))
    parts = stage_shared(counts.select("_user", F.ceil(F.col("_rows") / F.lit(part_rows)).alias("_parts"), "_rows"), "user_parts")
    # Users of several parts: rows / part_rows at most, so they are broadcast and the rows stay where they are.
    many = F.broadcast(parts.where("_parts > 1").select(F.col("_user").alias("_u"), "_parts"))
    n_parts = F.coalesce("_parts", F.lit(1).cast("long"))
    # Dealt out once by (user, part): the copy is bucketed, so a pass moves the users' weights, not the rows.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-(parts.agg(F.sum("_rows")).first()[0] or 0) // TASK_ROWS))
    dealt, table = stage_bucketed(train.join(many, F.col("_user").eqNullSafe(F.col("_u")), "left")
                                       .select("_user", F.pmod(F.xxhash64(key), n_parts).alias("_part"), "_y", *num_cols),
                                  "user_rows", tasks, "_user", "_part")
    dealt = dealt.withColumn(_INTERCEPT, F.lit(1.0))

    # The state after a pass: one row a user with its weight and the sums at that weight.
    state = parts.select("_user", "_parts", F.lit(0.0).alias("_weight"))
    b, best, move, steps = np.zeros(k), None, F.lit(0.0), 0
    penalty = np.array([1.0] * len(num_cols) + [0.0])
    size, delta, base = 1.0, np.zeros(k), None
    while True:
        here = state.select("_user", "_parts", (F.col("_weight") + move).alias("_weight"))
        spread = here.select(F.col("_user").alias("_u"), F.col("_parts"), "_weight",
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_p"))
        # (The rows without a user meet none: weight 0.)
        met = (dealt.join(spread.where("_u IS NOT NULL").hint("shuffle_hash"), (F.col("_user") == F.col("_u")) & (F.col("_part") == F.col("_p")), "left")
                    .withColumn("_weight", F.coalesce("_weight", F.lit(0.0))))
        eta = _linear(xs, b) + F.col("_weight")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_eta")))
        scored = met.withColumn("_eta", eta).withColumn("_e", p).withColumn("_s", F.col("_e") * (1 - F.col("_e")))
        # log(1 + e^eta) without overflow.
        loss = F.greatest("_eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta"))) - F.col("_y") * F.col("_eta")
        sums = {"_loss": loss, "_o": F.col("_y"), "_e": F.col("_e"), "_d": F.col("_s")}
        sums |= {f"_o{i}": F.col(x) * F.col("_y") for i, x in enumerate(xs)}
        sums |= {f"_e{i}": F.col(x) * F.col("_e") for i, x in enumerate(xs)}
        sums |= {f"_b{i}": F.col(x) * F.col("_s") for i, x in enumerate(xs)}
        sums |= {f"_a{i}_{j}": F.col(x) * F.col(xs[j]) * F.col("_s") for i, x in enumerate(xs) for j in range(i + 1)}
        by_part = scored.groupBy("_user", "_part", "_parts", "_weight").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
        state = stage_shared(by_part.groupBy("_user", "_parts", "_weight").agg(*[F.sum(n).alias(n) for n in sums]), "user_sums")
        steps += 1

        # Users are eliminated: g and d are a user's own gradient and curvature.  (The rows without a user have none.)
        known = F.col("_user").isNotNull()
        g = F.when(known, c * (F.col("_e") - F.col("_o")) + F.col("_weight")).otherwise(0.0)
        d = c * F.col("_d") + 1
        cross = [F.when(known, c * F.col(f"_b{i}")).otherwise(0.0) for i in range(k)]
        row = state.agg(
            (c * F.sum("_loss") + F.sum(F.when(known, F.col("_weight") * F.col("_weight")).otherwise(0.0)) / 2).alias("f"),
            F.max(F.abs(g)).alias("g"),
            *[F.sum(f"_o{i}").alias(f"o{i}") for i in range(k)], *[F.sum(f"_e{i}").alias(f"e{i}") for i in range(k)],
            *[F.sum(cross[i] * g / d).alias(f"r{i}") for i in range(k)],
            *[F.sum(c * F.col(f"_a{i}_{j}") - cross[i] * cross[j] / d).alias(f"h{i}_{j}")
              for i in range(k) for j in range(i + 1)]).first()
        if row["f"] is None:
            break                                           # no training rows
        value = row["f"] + float((penalty * b * b).sum()) / 2
        gradient = c * np.array([row[f"e{i}"] - row[f"o{i}"] for i in range(k)]) + penalty * b
        if max(float(np.abs(gradient).max()), row["g"]) < tolerance or steps >= MAX_STEPS:
            break
        if best is not None and value > best + 1e-9 * abs(best):    # too far: half of the step, from where it began
            size /= 2
            b, state = base[0] + size * delta, base[1]
            move = size * base[2]
            continue
        best = value
        h = np.diag(penalty).astype(float)
        for i in range(k):
            for j in range(i + 1):
                h[i, j] += row[f"h{i}_{j}"]
                h[j, i] = h[i, j]
        delta = -np.linalg.lstsq(h, gradient - np.array([row[f"r{i}"] for i in range(k)]), rcond=None)[0]
        step = F.lit(0.0)
        for i in range(k):
            step = step + cross[i] * F.lit(float(delta[i]))
        step = F.when(known, -(g + step) / d).otherwise(0.0)
        base, size = (b, state, step), 1.0
        b, move = b + delta, step
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    empty = row["f"] is None
    users = state.where("_user IS NOT NULL").select(
        F.col("_user").alias(user), F.col("_weight").alias("weight"), F.col("_o").alias("observed"),
        F.col("_e").alias("expected"), (c * (F.col("_e") - F.col("_o")) + F.col("_weight")).alias("gradient"))
    totals = {x: {"observed": 0.0, "expected": 0.0, "gradient": 0.0} if empty else
              {"observed": row[f"o{i}"], "expected": row[f"e{i}"], "gradient": float(gradient[i])} for i, x in enumerate(xs)}
    return UserRegression(dict(zip(xs, map(float, b))), users, totals, steps)


def scores(model: UserRegression, rows: DataFrame, num_cols: list[str], key: str, user: str, label: str) -> DataFrame:
    """L4: both splits scored.  A user without training rows has weight 0."""
    side = model.users.select(F.col(user).alias("_user"), F.col("weight").alias("_weight"))
    eta = (_linear(num_cols, np.array([model.weights[x] for x in num_cols])) + F.lit(model.weights[_INTERCEPT])
           + F.coalesce("_weight", F.lit(0.0)))
    met = rows.join(side, F.col(user) == F.col("_user"), "left").withColumn("p1", 1 / (1 + F.exp(-eta)))
    return met.select(key, F.col(label).cast("int").alias(label), "split", (F.col("p1") > 0.5).cast("int").alias("prediction"), "p1")


def optimality(model: UserRegression, rows: DataFrame, num_cols: list[str], user: str) -> DataFrame:
    """Every column's observed and expected training sums and gradient, by the names of ``sparse_design``.
    A user without training rows keeps weight and gradient 0."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(x, float(t["observed"]), float(t["expected"]), float(t["gradient"]))
                                   for x, t in model.totals.items()],
                                  "feature string, observed double, expected double, gradient double")
    codes = category_codes(rows, user, base=1)
    side = model.users.select(F.col(user).alias("_user"), "observed", "expected", "gradient")
    named = codes.join(side, F.col(user) == F.col("_user"), "left").select(
        F.concat(F.lit(f"{user}@"), F.col("code").cast("string")).alias("feature"),
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("observed", "expected", "gradient")])
    return fixed.unionByName(named)

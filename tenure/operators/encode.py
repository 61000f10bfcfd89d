"""Feature encoding (K1-K6).

Category codes come from the sorted distinct values, numbered with a
distributed running count, so even a user-id encoding (millions of values)
never passes through one task.  Scaling statistics are one aggregation over
an unpivoted (long) table and are joined back by feature name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.windows import prefix_sums

# Fixed values of the reference's model preparation (names made consistent).
NULL_FILL = 0.0
INF_FILL = 5.0
DROP_NUMERIC = ["avg_50", "avg_75", "avg_985", "avg_secs", "z_985", "z_50", "z_75", "z_secs",
                "z_50_3014", "z_75_3014", "z_985_3014", "z_secs_3014", "z_75_147", "z_985_147",
                "z_secs_147"]


def category_codes(df: DataFrame, col: str, base: int = 0) -> DataFrame:
    """(value, code): codes ``base``, ``base``+1, ... in ascending value order; NULL is no category."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = prefix_sums(d, [col], ["_one"])
    return ranked.select(col, (F.col("_one_cum") - 1 + base).cast("int").alias("code"))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """K1: replace a category by its 0-based rank in sorted order (LabelEncoder)."""
    codes = category_codes(df, col).withColumnRenamed("code", out or f"{col}_code")
    return df.join(codes, col, "left")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def one_hot_long(df: DataFrame, cat_cols: list[str], key: str = "msno") -> DataFrame:
    """K2 + K3: sparse one-hot in long form: (key, 'var@k', 1.0), k 1-based in sorted order.

    Every category is kept (no dropped level); a NULL is none.  Columns are
    unpivoted once per kind of value (text, whole number, other number), each
    in its own type, so 64-bit ids stay apart and numbers sort as numbers;
    codes are a running count per variable over the distinct (variable, value) pairs.
    """
    kinds: dict[str, list[str]] = {}
    for c, t in df.select(*cat_cols).dtypes:
        kinds.setdefault("string" if t == "string" else "bigint" if t in _WHOLE else "double", []).append(c)
    out = None
    for kind, cols in sorted(kinds.items()):
        parts = ", ".join(f"'{c}', CAST(`{c}` AS {kind})" for c in cols)
        long = df.selectExpr(key, f"stack({len(cols)}, {parts}) AS (variable, _value)").where("_value IS NOT NULL")
        distinct = long.select("variable", "_value").distinct().withColumn("_one", F.lit(1))
        codes = prefix_sums(distinct, ["_value"], ["_one"], group_cols=["variable"])
        part = long.join(codes, ["variable", "_value"]).select(
            key, F.concat(F.col("variable"), F.lit("@"), F.col("_one_cum").cast("string")).alias("feature"),
            F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def numeric_columns(columns: list[str], categorical: list[str], key: str = "msno",
                    label: str = "is_churn", drop: list[str] = DROP_NUMERIC) -> list[str]:
    """K4: everything that is not the key, the label, categorical, or on the drop list."""
    skip = set(categorical) | {key, label} | set(drop)
    return [c for c in columns if c not in skip]


def impute(c: F.Column, null_fill: float = NULL_FILL, inf_fill: float = INF_FILL) -> F.Column:
    """B9 + B10: NULL/NaN -> 0 first, then +-inf -> a constant."""
    x = c.cast("double")
    return (F.when(x.isNull() | F.isnan(x), F.lit(null_fill))
             .when(x.isin(float("inf"), float("-inf")), F.lit(inf_fill))
             .otherwise(x))


def unpivot(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    body = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(key, f"stack({len(cols)}, {body}) AS (feature, value)")


def minmax_scaled_long(df: DataFrame, num_cols: list[str], key: str = "msno",
                       inf_fill: float = INF_FILL) -> DataFrame:
    """K6: impute, then (x - min) / (max - min) per feature; a constant feature scales to 0.

    (Spark's MinMaxScaler maps a constant column to 0.5; scikit-learn to 0, kept here.)
    """
    long = unpivot(df, key, num_cols).withColumn("value", impute(F.col("value"), inf_fill=inf_fill))
    stats = long.groupBy("feature").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    # stats has one row per numeric feature (a fixed column list): safe to broadcast.
    rng = F.col("_mx") - F.col("_mn")
    return (long.join(F.broadcast(stats), "feature")
                .select(key, "feature",
                        F.when(rng == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("_mn")) / rng)
                         .alias("value")))


def variable_of(feature: F.Column) -> F.Column:
    """K5: 'var@k' -> 'var'."""
    return F.split(feature, "@").getItem(0)

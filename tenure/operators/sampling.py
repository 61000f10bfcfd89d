"""Deterministic sampling and splitting.

Randomness is a seeded md5 of the row key, so a sample is reproducible,
identical in any engine that has md5, and independent of partitioning.
Exact-n samples and slices are cut by rank of the hash without a global sort:
rows are counted per hash-prefix bucket, a running count finds the buckets in
which the cut's two ends fall, and only those buckets are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.windows import prefix_sums

DEFAULT_SEED = 42


def hash_key(key: str | Column, seed: int = DEFAULT_SEED, salt: str = "") -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:{salt}"), k.cast("string")))


def hash_int(key: str | Column, seed: int = DEFAULT_SEED, salt: str = "") -> Column:
    """First 32 bits of the md5 as a non-negative BIGINT."""
    return F.conv(F.substring(hash_key(key, seed, salt), 1, 8), 16, 10).cast("long")


def hash_unit(key: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """Uniform-looking value in [0, 1)."""
    return hash_int(key, seed) / F.lit(4294967296.0)


BUCKET_HEX = 5          # 2^20 hash buckets


def rank_cut(df: DataFrame, first: int, last: int, key: str = "msno", seed: int = DEFAULT_SEED) -> DataFrame:
    """The rows of rank ``first`` .. ``last`` (1-based) in hash order; ``key`` identifies a row.

    Whole buckets strictly between the two ends are taken as they are; the
    (at most two) buckets that hold an end, about rows / 2^20 keys each, are ranked.
    """
    cols = df.columns
    d = (df.withColumn("_h", hash_key(key, seed))
           .withColumn("_bucket", F.conv(F.substring("_h", 1, BUCKET_HEX), 16, 10).cast("long")))
    counts = d.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = prefix_sums(counts, ["_bucket"], ["_cnt"])
    ends = cum.filter(F.col("_cnt_cum") >= first).select(
        "_bucket", "_cnt_cum", (F.col("_cnt_cum") - F.col("_cnt")).alias("_before"))
    low = ends.agg(F.min("_bucket").alias("b"), F.min_by("_before", "_bucket").alias("n"))
    high = ends.filter(F.col("_cnt_cum") >= last).agg(F.min("_bucket").alias("b"), F.min_by("_before", "_bucket").alias("n"))
    low_bucket, low_before = low.select("b").scalar(), low.select("n").scalar()
    high_bucket, high_before = high.select("b").scalar(), high.select("n").scalar()
    inside = d.filter((F.col("_bucket") > low_bucket)
                      & (F.col("_bucket") < F.coalesce(high_bucket, F.lit(1 << (4 * BUCKET_HEX)))))
    w = Window.partitionBy("_bucket").orderBy("_h")
    before = F.when(F.col("_bucket") == low_bucket, low_before).otherwise(high_before)
    edge = (d.filter((F.col("_bucket") == low_bucket) | (F.col("_bucket") == high_bucket))
             .withColumn("_rank", F.row_number().over(w) + before)
             .filter((F.col("_rank") >= first) & (F.col("_rank") <= last)))
    return inside.select(*cols).unionByName(edge.select(*cols))


def sample_exact(df: DataFrame, n: int, key: str = "msno", seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the n smallest key hashes."""
    return rank_cut(df, 1, n, key, seed) if n > 0 else df.limit(0)


def downsample_majority(df: DataFrame, label_col: str, majority_value, n: int, key: str = "msno",
                        seed: int = DEFAULT_SEED) -> DataFrame:
    """I2 + H2 (+ B4 class filters): keep every minority row, draw n majority rows, union."""
    keep = df.filter(F.col(label_col) != F.lit(majority_value))
    drawn = sample_exact(df.filter(F.col(label_col) == F.lit(majority_value)), n, key, seed)
    return keep.unionByName(drawn)


def stratified_sample(df: DataFrame, label_col: str, n_per_class: dict, key: str = "msno",
                      seed: int = DEFAULT_SEED) -> DataFrame:
    """A fixed number of rows per class (capped at the class size).

    One rank cut per class; no window over a whole class.
    """
    out = None
    for value, n in sorted(n_per_class.items()):
        part = sample_exact(df.filter(F.col(label_col) == F.lit(value)), n, key, seed)
        out = part if out is None else out.unionByName(part)
    return out


def numbered_keys(df: DataFrame, key: str = "msno", seed: int = DEFAULT_SEED) -> DataFrame:
    """Distinct keys numbered 0..N-1 in hash order (distributed running count)."""
    ids = df.select(key).distinct().withColumn("_h", hash_key(key, seed)).withColumn("_one", F.lit(1))
    ranked = prefix_sums(ids, ["_h"], ["_one"])
    return ranked.select(key, (F.col("_one_cum") - 1).alias("position"))


def sample_with_replacement(df: DataFrame, n_draws: int, key: str = "msno",
                            seed: int = DEFAULT_SEED) -> DataFrame:
    """I4: n draws with replacement from the distinct keys, returned as the set drawn.

    Draw i picks position md5(seed:d:i) mod N of the hash-ordered keys.
    """
    numbered = numbered_keys(df, key, seed)
    n_keys = numbered.select(F.count(F.lit(1))).scalar()
    draws = (df.sparkSession.range(n_draws)
               .select((hash_int(F.col("id"), seed, "d:") % n_keys).alias("position")).distinct())
    return numbered.join(draws, "position", "left_semi").select(key)


def train_test_split(df: DataFrame, test_fraction: float, key: str = "msno",
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """Deterministic split by key hash; the share is approximate, not promised."""
    return df.withColumn("split", F.when(hash_unit(key, seed) < F.lit(1.0 - test_fraction),
                                         F.lit("train")).otherwise(F.lit("test")))


def sample_slice(df: DataFrame, offset: int, n: int, key: str = "msno",
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows offset..offset+n-1 of the hash order (the reference's ``[1:20]``)."""
    return rank_cut(df, offset + 1, offset + n, key, seed) if n > 0 else df.limit(0)

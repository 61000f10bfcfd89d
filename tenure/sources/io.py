"""File sources and sinks.

CSV is read with a declared schema (never inferred) and integer yyyymmdd
columns become DATE on read.  Sinks never write a row index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenure.functions.dates import ymd_int_to_date
from tenure.sources.schemas import BY_NAME, DATE_COLUMNS


def read_retention_csv(spark: SparkSession, path: str, table: str, parse_dates: bool = True) -> DataFrame:
    """A1 + A2: one of members / transactions / user_logs / train from CSV with a header."""
    df = spark.read.schema(BY_NAME[table]).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if parse_dates:
        for c in DATE_COLUMNS[table]:
            df = df.withColumn(c, ymd_int_to_date(c))
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def result_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """A small result table as CSV, read back under its own schema."""
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """A5: materialise an intermediate as parquet and continue from the written copy.

    Use a folder on shared storage (e.g. under ``spark.checkpoint.dir``): the
    written table survives executor loss and cuts the lineage.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

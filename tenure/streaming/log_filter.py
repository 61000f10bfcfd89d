"""Incremental version of the reference's chunked log scan (A3).

New log files arrive in a folder; each micro-batch keeps only the rows of
the chosen users (a stream-static LEFT SEMI join) and appends them to a
parquet table.  No state and no watermark are needed: every row is decided
on its own, and the sink's append replaces the reference's append of
filtered chunks (H3).  The checkpoint makes the append exactly-once across restarts
and executor loss; ``availableNow`` drains what is there and stops, which
makes the result equal to the batch ``keep_users`` on the same files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tenure.session import ensure_checkpoint_dir


def stream_keep_users(spark: SparkSession, source: str, schema: T.StructType, users: DataFrame,
                      key: str, sink_path: str, checkpoint_path: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the filter-and-append stream until the source is drained; return the sink table.

    ``source`` is the table's own path: a folder of part files, or one file.
    ``users`` is read again in every micro-batch, so pass a written table.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # As a pattern that matches this one path, the source may be a folder or a single file.
    source = source.rstrip("/")
    kept = reader.parquet(f"{source[:-1]}[{source[-1]}]").join(users, key, "left_semi")
    query = (kept.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", checkpoint_path)
                 .trigger(availableNow=True).start(sink_path))
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink_path)


def run_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, checkpoint) folders for one run, under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{root}/tenure-streams/{name}-{uuid.uuid4().hex}"
    return f"{run}/table", f"{run}/checkpoint"

"""Session helpers.

Library code never builds its own session; it takes the caller's.  The
builder here is for tests, the bench and local runs only.  Intermediate
tables and checkpoints go below the shared folder the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session may do without that
setting; it then gets a temporary folder that is removed at exit.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tenure") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TENURE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Raises on a cluster that names none: a folder on one machine would be
    invisible to the other executors.  In local mode (one machine) a temporary
    folder is made instead and removed when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        one_machine = sc.master == "local" or sc.master.startswith("local[")
        if not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tenure-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the configured checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's checkpoint folder.  That folder is this
    application's own (Spark adds a unique name to it), so everything staged
    goes when the folder is removed after the application."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tenure-stage/{name}-{uuid.uuid4().hex}"


def stage_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to a fresh folder under the checkpoint folder and
    continue from the written copy: one computation for several readers, a
    lineage cut that survives executor loss, and columnar, prunable reads."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> tuple[DataFrame, str]:
    """As ``stage_shared``, in ``buckets`` hash buckets of ``keys``: joins and groupings by them read the copy
    in place.  The files lie below the checkpoint folder; the table's name, also returned, is the caller's to drop."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
       .option("path", path).saveAsTable(table))
    return spark.table(table), table

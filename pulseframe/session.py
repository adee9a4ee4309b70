"""Session construction and lineage truncation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pulseframe", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PULSEFRAME_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a private one only on a local master."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulseframe-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """A new path below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base}/pulseframe-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Lineage ends here and lost executors cost nothing; later reads prune columns, and values
    no longer depend on how a partition is recomputed.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan with fewer splits than cores before per-row heavy work.

    Large inputs have many splits and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df

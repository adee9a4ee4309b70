"""Parquet, CSV and JSON tables: projected scans, write-once publishing, rejects and their replay."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of the named columns only."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def publish(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write once; an existing target is an error."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S20."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Manifests as JSON lines."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def paired_mismatch(arrays: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Keys present in only one of the array table and its metadata (must be empty)."""
    a, m = arrays.select(key, F.lit(1).alias("_a")), meta.select(key, F.lit(1).alias("_m"))
    x = a.join(m, key, "full").filter("_a is null or _m is null")
    return x.select(key, F.when(F.col("_a").isNull(), "no_array").otherwise("no_metadata").alias("problem"))


REJECT_SCHEMA = "record_id string, dataset string, step string, error string, raw_path string, timestamp timestamp"


def append_rejects(df: DataFrame, path: str) -> None:
    """Append rejected rows."""
    df.write.mode("append").json(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REJECT_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def replay(rejects: DataFrame, job: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("dataset", "record_id")) -> tuple[DataFrame, DataFrame]:
    """Run the job again on the rejected keys; the entries that stay, and counts by outcome.

    `job` returns the rows that now succeed. Entries without a key are invalid and dropped.
    """
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    valid = rejects.filter(usable)
    done = job(valid.select(*keys).distinct()).select(*keys).distinct()
    kept = valid.join(done, list(keys), "left_anti")
    n = lambda df, s: df.agg(F.count("*").alias("n")).withColumn("outcome", F.lit(s))
    counts = n(valid.join(done, list(keys), "left_semi"), "success").unionByName(n(kept, "kept")).unionByName(n(rejects.filter(~usable), "invalid"))
    return kept, counts


def matrix_metrics(spark: SparkSession, root: str, done: DataFrame, schema: str) -> DataFrame:
    """Metrics.json of candidate=/fold=/seed= directories, completed cells only."""
    m = spark.read.schema(schema).option("basePath", root).option("multiLine", True).json(f"{root}/candidate=*/fold=*/seed=*/metrics.json")
    return m.join(done, ["candidate", "fold", "seed"], "left_semi")


def matrix_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of all cells with their partition columns."""
    return spark.read.option("basePath", root).parquet(f"{root}/candidate=*")


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """One row per text file."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return df.select(F.input_file_name().alias("source"), F.col("value").alias("text"))

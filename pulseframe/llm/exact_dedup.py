"""Exact deduplication by a stateful stream; DataFrame and SQL functions only.

A stream reads (digest, id, locator) rows and keeps, for every digest ever seen and without
expiry, how many rows it had and which row stands for them. The state lives in a disk-backed
store (RocksDB) whose checkpoint is in the shared folder, so a lost executor reloads it. The
state is read back as a table; rows that hit a digest with more than one row are then compared
byte for byte with the row that stands for it, and rows that differ (equal digests of different
texts) are grouped by their whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_folder
from .common import clean_name, pinned, without

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store sets 4 MB of disk aside
}

# Digests of repeated texts (32 bytes each) are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_HITS = 1_000_000


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def ingest(source: str, schema, checkpoint: str, spark, bytes_per_batch: int = 16 << 30) -> None:
    """Run the stream over all files of the folder `source` that the checkpoint has not seen yet.

    Calling it again after more files have arrived continues from the kept state.
    """
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(source)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "file")).alias("rep"))
        q = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark, checkpoint: str) -> DataFrame:
    """The kept state: digest, n (rows seen), keep_id, keep_file (locator of the row that stands for it)."""
    s = spark.read.format("statestore").load(checkpoint)
    n, rep = [f.name for f in s.schema["value"].dataType.fields]
    return s.select("key.digest", F.col(f"value.{n}").alias("n"), F.col(f"value.{rep}.id").alias("keep_id"), F.col(f"value.{rep}.file").alias("keep_file"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, bytes_per_batch: int = 16 << 30) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. The largest id of equal texts
    stays. A null id is smaller than any other and stays only if all ids of the group are null.
    A row repeated with the same id counts in group_size and is kept as often as it is there.
    Other columns of `docs` are ignored, whatever their names. No rows give no rows. `digest` may
    be any function of the text: equal digests of different texts are told apart by the bytes.
    """
    spark = docs.sparkSession
    key = F.unhex(digest(F.col(text_col)))
    folder = shared_folder(spark)
    docs.select(F.col(id_col).alias("id"), key.alias("digest"), F.input_file_name().alias("file")).write.parquet(f"{folder}/arrivals")
    arrivals = spark.read.parquet(f"{folder}/arrivals")
    ingest(f"{folder}/arrivals", arrivals.schema, f"{folder}/state", spark, bytes_per_batch)
    state = pinned(read_state(spark, f"{folder}/state").select(F.col("digest").alias("d"), "n", "keep_id"))
    hits = state.filter("n > 1")
    # Only rows that hit need their bytes; the digests to look for are broadcast while they are few.
    wanted = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    base = docs.select(F.col(id_col).alias("id"), key.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    full = base.join(wanted, F.col("digest") == F.col("d"))
    reps = full.filter("id <=> keep_id").groupBy("d").agg(F.min("text").alias("rep_text"))
    odd = pinned(full.select("id", "digest", "text").join(reps, F.col("digest") == F.col("d")).filter("not (text <=> rep_text)").select("id", "digest", "text"))
    out = arrivals.join(state, F.col("digest") == F.col("d")).select("id", "digest", "n", "keep_id")
    if not odd.isEmpty():  # equal digests of different texts
        groups = odd.groupBy("digest", "text").agg(F.max("id").alias("k2"), F.count("*").alias("n2"))
        apart = odd.select("id", "digest").groupBy("id", "digest").agg(F.count("*").alias("times")).join(odd.select("id", "digest", "text").distinct().join(groups, ["digest", "text"]), ["id", "digest"])
        less = odd.groupBy("digest").agg(F.count("*").alias("n3"))
        marks = odd.select("id", "digest").distinct()
        same = out.join(marks, out["id"].eqNullSafe(marks["id"]) & (out["digest"] == marks["digest"]), "left_anti").join(less, "digest", "left").select("id", "keep_id", (F.col("n") - F.coalesce("n3", F.lit(0))).alias("n"), "digest")
        out = same.unionByName(apart.select("id", F.col("k2").alias("keep_id"), F.col("n2").alias("n"), "digest"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, all columns as they were."""
    gone_id, gone_sha = clean_name(docs, "_gone_id"), clean_name(docs, "_gone_sha")
    gone = exact_dedup(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    return without(docs, gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (sha256(F.col(text_col)) == F.col(gone_sha)))

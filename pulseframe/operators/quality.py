"""Data-quality and lineage checks: every check is a row (code, status, count, total)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as A
from .sets import check, duplicate_keys, shared, union_all


def rows_of(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All predicate checks of a table in one pass: a check counts the rows where it is true."""
    n = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"_{k}") for k, c in checks.items()])
    return n.select(F.inline(F.array(*[check(k, F.col(f"_{k}"), F.col("_n")) for k in checks])))


def from_bad(bad: DataFrame, code: str) -> DataFrame:
    """Check row of a frame that must be empty."""
    return bad.agg(F.count("*").alias("n")).select(F.inline(F.array(check(code, F.col("n"), F.col("n")))))


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q1."""
    missing = [c for c in columns if c not in df.columns]
    return df.sparkSession.createDataFrame([("REQUIRED_COLUMNS", "FAIL" if missing else "PASS", len(missing), len(columns))], "code string, status string, count long, total long")


def sample_checks(beats: DataFrame, identity: DataFrame, folds: DataFrame, classes: Sequence[str], fs: float = 500.0) -> DataFrame:
    """Q2: nulls, ids, clocks, labels, and agreement with the identity and fold tables."""
    rebuilt = F.concat_ws(":", F.col("dataset").cast("string"), F.col("record_id").cast("string"), F.lit("beat"), F.col("beat_idx").cast("string"), F.lit("target"), F.col("peak").cast("string"))
    keys = ["dataset", "record_id", "beat_idx", "peak", "label", "sample_id"]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    local = rows_of(beats, {
        "NULL_KEYS": null,
        "ID_RECONSTRUCTION": F.col("sample_id") != rebuilt,
        "NOT_FINITE": F.isnan("seconds") | (F.abs("seconds") == F.lit(float("inf"))),
        "CLOCK_TOLERANCE": F.abs(F.col("peak") / F.lit(fs) - F.col("native") / F.col("fs_native")) > 0.5 / fs + 1e-9,
        "TIME_TOLERANCE": F.abs(F.col("native") / F.col("fs_native") - F.col("seconds")) > 1e-9,
        "UNKNOWN_LABEL": ~F.col("label").isin(list(classes)),
        "BINARY_SEMANTICS": F.when(F.col("label") == "N", 0).otherwise(1) != F.col("y_binary"),
    })
    dup = from_bad(duplicate_keys(beats, ["sample_id"]), "DUPLICATE_IDS")
    rec = beats.select("dataset", "record_id").distinct()
    noid = from_bad(rec.join(identity, ["dataset", "record_id"], "left_anti"), "NO_IDENTITY")
    nofold = from_bad(rec.join(identity, ["dataset", "record_id"]).filter("role = 'train'").join(folds, "patient_id", "left_anti"), "NO_FOLD")
    return union_all([local, dup, noid, nofold])


def episode_checks(ep: DataFrame, length: int) -> DataFrame:
    """Q3: order, length, containment and id of rhythm episodes."""
    rebuilt = F.concat_ws(":", F.lit("episode"), F.col("record_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    local = rows_of(ep, {
        "BOUNDARIES": F.col("end") <= F.col("start"),
        "LENGTH": F.col("end") - F.col("start") != length,
        "CONTAINMENT": ~F.coalesce((F.col("interval_start") <= F.col("start")) & (F.col("end") <= F.col("interval_end")), F.lit(False)),
        "ID_RECONSTRUCTION": F.col("episode_id") != rebuilt,
    })
    return union_all([local, from_bad(duplicate_keys(ep, ["episode_id"]), "DUPLICATE_IDS")])


def leakage_report(rows: DataFrame, assign: DataFrame, group: str, label: str, classes: Sequence, low: int = 10) -> DataFrame:
    """Q6: groups in several folds, empty classes and classes of low support per fold."""
    from .splits import crossing_groups

    n = rows.join(assign, group).groupBy("fold").agg(*[F.count_if(F.col(label) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)])
    empty = sum((F.when(F.col(f"c{i}") == 0, 1).otherwise(0) for i in range(len(classes))), F.lit(0))
    weak = sum((F.when(F.col(f"c{i}").between(1, low - 1), 1).otherwise(0) for i in range(len(classes))), F.lit(0))
    a = n.agg(F.sum(empty).alias("e"), F.sum(weak).alias("w"), F.count("*").alias("n"))
    r = a.select(F.inline(F.array(check("EMPTY_CLASS", F.col("e"), F.col("n")), check("LOW_SUPPORT", F.col("w"), F.col("n")))))
    return union_all([from_bad(crossing_groups(assign, group), "GROUP_OVERLAP"), r])


def source_leakage(sources: DataFrame, held_out: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q8."""
    return from_bad(shared(sources, held_out, cols), "SOURCE_LEAKAGE")


def record_audit(df: DataFrame, samples: str, fs: float, z_limit: float = 10.0, flat: float = 1e-3, zeros: float = 0.5, seconds: float = 1.0) -> DataFrame:
    """Q7: sample-level faults per record, counted over all records."""
    c = F.col(samples)
    bad = F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = df.select(
        bad.alias("bad"), (A.std(samples) < flat).alias("flat"), F.exists(c, lambda v: ~F.isnan(v) & (F.abs(v) > z_limit)).alias("z"),
        (F.size(F.filter(c, lambda v: v == 0)) / F.size(c) > zeros).alias("zero"), (F.size(c) / F.lit(fs) < seconds).alias("short"))
    return rows_of(x, {"NAN_INF": F.col("bad"), "FLATLINE": F.col("flat"), "ZSCORE_RANGE": F.col("z"), "ZERO_RATIO": F.col("zero"), "DURATION": F.col("short")})


def label_audit(df: DataFrame, label: str, group: str, classes: Sequence, minimum: int, k: int, paced: Sequence = (), pii_columns: Sequence[str] = ("patient_name", "cpf", "email")) -> DataFrame:
    """Q7: class minimum, fold feasibility, paced share and personal-data columns."""
    n = df.groupBy(label).agg(F.count("*").alias("n"), F.countDistinct(group).alias("g")).filter(F.col(label).isin(list(classes)))
    a = n.agg(F.count_if(F.col("n") < minimum).alias("m"), F.count_if(F.col("g") < k).alias("f"), F.count("*").alias("t"))
    r = a.select(F.inline(F.array(check("CLASS_MINIMUM", F.col("m") + (F.lit(len(classes)) - F.col("t")), F.lit(len(classes))), check("FOLD_FEASIBILITY", F.col("f"), F.col("t")))))
    p = rows_of(df, {"PACED": F.col(label).isin(list(paced)) if paced else F.lit(False)})
    found = [c for c in df.columns if c.lower() in pii_columns]
    q = df.sparkSession.createDataFrame([("PII_COLUMNS", "FAIL" if found else "PASS", len(found), len(df.columns))], "code string, status string, count long, total long")
    return union_all([r, p, q])


def overall(checks: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Verdict over check rows."""
    x = checks.filter(~F.col("code").isin(list(ignore)))
    return x.agg(F.count_if(F.col("status") == "FAIL").alias("n_failed"), F.count("*").alias("n_checks")).withColumn("verdict", F.when(F.col("n_failed") > 0, "FAIL").otherwise("PASS"))


def archive_check(files: DataFrame, manifest: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Q9: size within a tolerance and equal hash; entries without an expectation pass."""
    x = manifest.join(files, "path", "left")
    size_ok = F.col("expected_size").isNull() | F.coalesce(F.abs(F.col("size") - F.col("expected_size")) <= F.col("expected_size") * tolerance, F.lit(False))
    hash_ok = F.col("expected_sha256").isNull() | F.coalesce(F.col("sha256") == F.col("expected_sha256"), F.lit(False))
    return x.select("path", size_ok.alias("size_ok"), hash_ok.alias("hash_ok"), F.col("size").isNotNull().alias("present"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Q10: size and SHA-256 of every file below a path."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def directory_checksum(files: DataFrame) -> DataFrame:
    """Q10: digest of all (path, hash) lines; lines are digested per path-hash bucket, then the buckets."""
    line = F.concat_ws(" ", "path", "sha256")
    b = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return b.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "b", "h"))), "\n"), 256).alias("checksum"), F.sum("n").alias("n_files"))


def schema_hash(names: Sequence[str]) -> Column:
    """Q12."""
    return F.sha2(F.to_json(F.array(*[F.lit(n) for n in names])), 256)


def schema_compatible(df: DataFrame, expected: Sequence[str], got: Sequence[str]) -> DataFrame:
    """Q12: do two feature lists have the same hash."""
    return df.limit(1).select(F.lit("FEATURE_SCHEMA").alias("code"), F.when(schema_hash(expected) == schema_hash(got), "PASS").otherwise("FAIL").alias("status"))


def prediction_checks(parts: DataFrame, partition: str, record: str, y: str, p: str) -> DataFrame:
    """Q13: lengths, finite scores in [0, 1], and records shared by partitions."""
    local = rows_of(parts, {
        "MISSING_VALUE": F.col(y).isNull() | F.col(p).isNull(),
        "NOT_FINITE": F.isnan(p) | (F.abs(p) == F.lit(float("inf"))),
        "SCORE_RANGE": (F.col(p) < 0) | (F.col(p) > 1),
    })
    multi = parts.select(record, partition).distinct().groupBy(record).agg(F.count("*").alias("n")).filter("n > 1")
    return union_all([local, from_bad(multi, "RECORD_OVERLAP")])

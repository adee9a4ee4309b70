"""Record catalogs: header text to catalog rows, JSON-lines scan and contract, record selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_INTS, _STRS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())

# The nineteen catalog fields.
CATALOG_SCHEMA = T.StructType([
    T.StructField("record_name", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("fs", T.IntegerType()), T.StructField("n_sig", T.IntegerType()),
    T.StructField("sig_len", T.LongType()), T.StructField("duration_sec", T.DoubleType()), T.StructField("units", _STRS), T.StructField("gains", _INTS),
    T.StructField("baselines", _INTS), T.StructField("adc_res", _INTS), T.StructField("adc_zero", _INTS), T.StructField("initial_value", _INTS), T.StructField("checksum", _INTS),
    T.StructField("sig_name", _STRS), T.StructField("comments", _STRS), T.StructField("age", T.IntegerType()), T.StructField("sex", T.StringType()),
    T.StructField("diagnosis", T.StringType()), T.StructField("source_path", T.StringType()),
])
REQUIRED = ["record_name", "dataset", "fs", "n_sig", "sig_len"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Strict scan; a malformed line fails the job."""
    return spark.read.schema(CATALOG_SCHEMA).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines that meet the contract, and the rejected lines with the reason."""
    return check_lines(spark.read.text(path), "value")


def check_lines(df: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    rec = F.from_json(F.col(line), T.StructType([*CATALOG_SCHEMA.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    x = df.withColumn("_r", rec)
    missing = F.array_compact(F.array(*[F.when(F.col(f"_r.{c}").isNull(), c) for c in REQUIRED]))
    why = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    x = x.withColumn("error", why)
    return x.filter("error is null").select("_r.*").drop("_bad"), x.filter("error is not null").select(F.col(line).alias("line"), "error")


def comment_fields(comments: Column) -> dict[str, Column]:
    """S3: age, sex and diagnosis of the comment lines."""
    text = F.array_join(comments, "\n")

    def first(pattern: str) -> Column:
        v = F.regexp_extract(text, pattern, 1)
        return F.when(v != "", v)

    return {
        "age": first(r"(?i)\bage[:\s]+(\d+)\b").cast("int"),
        "sex": F.upper(first(r"(?i)\bsex[:\s]+([mf])\b")),
        "diagnosis": F.trim(first(r"(?i)\b(?:dx|diagnosis)[:\s]+([^\n]+)")),
    }


def from_headers(headers: DataFrame, text: str = "value", dataset: str = "dataset", path: str = "path") -> DataFrame:
    """Catalog rows of header texts (record line, one line per signal, # comments)."""
    lines = F.filter(F.transform(F.split(F.col(text), "\r?\n"), lambda v: F.trim(v)), lambda v: v != "")
    x = headers.withColumn("_l", lines)
    x = x.withColumn("comments", F.transform(F.filter("_l", lambda v: v.startswith("#")), lambda v: F.trim(F.substring(v, 2, 1 << 20))))
    x = x.withColumn("_l", F.filter("_l", lambda v: ~v.startswith("#")))
    head = F.split(F.get("_l", F.lit(0)), r"\s+")
    x = x.withColumn("_h", head).withColumn("_s", F.transform(F.slice("_l", 2, 1 << 20), lambda v: F.split(v, r"\s+")))
    field = lambda i: F.get("_h", F.lit(i))
    sig = lambda i: F.transform("_s", lambda v: F.get(v, F.lit(i)).try_cast("int"))
    fs = F.regexp_extract(field(2), r"^(\d+)", 1).try_cast("int")
    n = field(3).try_cast("long")
    return x.select(
        field(0).alias("record_name"), F.col(dataset).alias("dataset"), F.coalesce(fs, F.lit(0)).alias("fs"), F.coalesce(field(1).try_cast("int"), F.lit(0)).alias("n_sig"),
        F.coalesce(n, F.lit(0)).cast("long").alias("sig_len"), F.when(fs > 0, F.coalesce(n, F.lit(0)) / fs).otherwise(0.0).alias("duration_sec"),
        F.transform("_s", lambda v: F.regexp_extract(F.get(v, F.lit(2)), r"/(\w+)", 1)).alias("units"),
        F.transform("_s", lambda v: F.regexp_extract(F.get(v, F.lit(2)), r"^(\d+)", 1).try_cast("int")).alias("gains"),
        F.transform("_s", lambda v: F.coalesce(F.regexp_extract(F.get(v, F.lit(2)), r"\((-?\d+)\)", 1).try_cast("int"), F.get(v, F.lit(4)).try_cast("int"))).alias("baselines"),
        sig(3).alias("adc_res"), sig(4).alias("adc_zero"), sig(5).alias("initial_value"), sig(6).alias("checksum"),
        F.transform("_s", lambda v: F.array_join(F.slice(v, 9, 1 << 20), " ")).alias("sig_name"), "comments",
        *[c.alias(k) for k, c in comment_fields(F.col("comments")).items()], F.col(path).alias("source_path"))


def build_catalog(headers: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Usable rows and the number of ok, failed and skipped (no signal) headers."""
    x = from_headers(headers, **kw).withColumn("_st", F.when((F.col("sig_len") == 0) | (F.col("n_sig") == 0), "skipped").when((F.col("record_name") == "") | (F.col("fs") == 0), "failed").otherwise("ok"))
    return x.filter("_st = 'ok'").drop("_st"), x.groupBy(F.col("_st").alias("status")).agg(F.count("*").alias("n"))


def select_by_confidence(df: DataFrame, codes: str, ident: str, key: str = "AFIB", threshold: float = 100.0, width: int = 5) -> DataFrame:
    """Ids whose dict-literal column gives `key` at least a confidence."""
    m = F.from_json(F.translate(codes, "'", '"'), "map<string,double>")
    return df.filter(F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0.0)) >= threshold).select(F.lpad(F.col(ident).cast("string"), width, "0").alias("record_id"))


def read_confidence_csv(spark: SparkSession, path: str, **kw) -> DataFrame:
    df = spark.read.schema("ecg_id long, patient_id double, scp_codes string").option("header", True).option("enforceSchema", False).csv(path)
    return select_by_confidence(df, "scp_codes", "ecg_id", **kw)


def grouped(catalog: DataFrame, dataset: Sequence[str] | None = None) -> DataFrame:
    """Catalog rows of the named data sets."""
    return catalog if dataset is None else catalog.filter(F.col("dataset").isin(list(dataset)))

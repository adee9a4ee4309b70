"""Training logs and nested JSON histories as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EPOCH = r"Epoch\s+(\d+)/\d+\s*\n.*?loss:\s+([\d.]+).*?accuracy:\s+([\d.]+).*?val_loss:\s+([\d.]+).*?val_accuracy:\s+([\d.]+)"


def training_log(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per epoch; a missing F1 is zero. Whole log texts, one per row."""
    col = F.col(text)
    names = ["epoch", "train_loss", "train_acc", "val_loss", "val_acc"]
    parts = [F.regexp_extract_all(col, F.lit(EPOCH), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    f1 = F.regexp_extract_all(col, F.lit(r"val_f1_macro:\s+([\d.]+)"), F.lit(1))
    x = df.select(key, F.posexplode(F.arrays_zip(*parts)).alias("_i", "_z"), f1.alias("_f"))
    return x.select(key, F.col("_z.epoch").cast("int").alias("epoch"), *[F.col(f"_z.{n}").cast("double").alias(n) for n in names[1:]], F.coalesce(F.get("_f", F.col("_i")).cast("double"), F.lit(0.0)).alias("val_f1_macro"))


LAYERS = "array<struct<epoch:int, layers:array<struct<layer_name:string, norm_ratio:double, p95_gradient:double>>>>"
BINS = "array<struct<epoch:int, ece:double, mce:double, brier_score:double, brier_per_class:map<string,double>, reliability_bins:array<struct<bin:int, accuracy:double, confidence:double, count:long>>>>"


def gradient_history(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, epoch, layer, norm_ratio, p95_gradient)."""
    x = df.select(key, F.explode(F.from_json(text, LAYERS)).alias("e")).select(key, "e.epoch", F.explode("e.layers").alias("l"))
    return x.select(key, "epoch", F.col("l.layer_name").alias("layer"), "l.norm_ratio", "l.p95_gradient")


def calibration_history(df: DataFrame, text: str, key: str, classes: tuple[str, ...] = ("S", "V", "F")) -> tuple[DataFrame, DataFrame]:
    """Per-epoch calibration values, and their reliability bins."""
    x = df.select(key, F.explode(F.from_json(text, BINS)).alias("e"))
    per = [F.coalesce(F.try_element_at("e.brier_per_class", F.lit(c)), F.lit(0.0)).alias(f"brier_{c.lower()}") for c in classes]
    values = x.select(key, "e.epoch", "e.ece", "e.mce", F.col("e.brier_score").alias("brier"), *per)
    bins = x.select(key, "e.epoch", F.explode("e.reliability_bins").alias("b")).select(key, "epoch", "b.bin", "b.accuracy", "b.confidence", "b.count")
    return values, bins

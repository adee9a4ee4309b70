"""Imputation, scaling and pyspark.ml based probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import pinned
from .ordering import hash_int, numbered, percentiles, stable_hash
from .splits import group_folds


def impute_medians(df: DataFrame, train: DataFrame, feature: str, cls: str, value: str) -> DataFrame:
    """Null values take the training median of their class, else the training median of the feature."""
    c = percentiles(train, [feature, cls], value, {"_mc": 0.5})
    g = percentiles(train, [feature], value, {"_mg": 0.5})
    x = df.join(c, [feature, cls], "left").join(g, feature, "left")
    return x.withColumn(value, F.coalesce(value, "_mc", "_mg")).drop("_mc", "_mg")


def fit_scaler(train: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean and population std per feature of the training rows; a constant feature gets scale 1."""
    a = train.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"))
    return a.select(feature, "mean", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("scale"))


def scale(df: DataFrame, scaler: DataFrame, feature: str, value: str, name: str = "z") -> DataFrame:
    return df.join(scaler, feature).withColumn(name, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def balanced_accuracy(pred: DataFrame, y: str, p: str) -> float:
    r = pred.groupBy(y).agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("r"))
    return float(r.agg(F.avg("r")).head()[0])


def identity_probe(df: DataFrame, vec: str, source: str, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Can a linear model tell the data sets apart? Group-wise held-out balanced accuracy against chance."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    folds = group_folds(df, group, k, seed)
    x = pinned(df.join(folds, group).select("fold", F.col(source).cast("double").alias("label"), array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("features")))
    n_sources = x.select("label").distinct().count()
    rows = []
    for f in range(k):
        m = LogisticRegression(maxIter=50, regParam=0.01).fit(x.filter(F.col("fold") != f))
        rows.append((f, balanced_accuracy(m.transform(x.filter(F.col("fold") == f)), "label", "prediction"), 1.0 / n_sources))
    return df.sparkSession.createDataFrame(rows, "fold int, balanced_accuracy double, chance double")


def _forest(x: DataFrame, features: Sequence[str], y: str, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="_f")
    m = RandomForestClassifier(featuresCol="_f", labelCol=y, numTrees=20, maxDepth=6, seed=seed).fit(va.transform(x))
    return lambda d: m.transform(va.transform(d)).select(y, "prediction")


def permutation_importance(df: DataFrame, features: Sequence[str], y: str, ident: Sequence[str], seed: int = 42, train_share: float = 0.8) -> DataFrame:
    """Loss of balanced accuracy when one feature is permuted among the held-out rows."""
    h = stable_hash(*ident, seed=seed)
    x = pinned(df.withColumn("_h", h).withColumn("_t", hash_int(F.col("_h"), 1, 8) < int(4294967296 * train_share)))
    predict = _forest(x.filter("_t"), features, y, seed)
    test = x.filter(~F.col("_t"))
    base = balanced_accuracy(predict(test), y, "prediction")
    rows = []
    for f in features:
        # row i takes the value of the row ranked i by another hash: an exact permutation
        a = numbered(test, [], F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), [F.col("_h"), *map(F.col, ident)], "_i")
        k = stable_hash("_h", F.lit(f), seed=seed)
        b = test.select(F.col(f).alias("_v"), k.alias("_k"))
        b = numbered(b, [], F.conv(F.substring("_k", 1, 3), 16, 10).cast("long"), [F.col("_k"), F.col("_v")], "_i")
        p = a.drop(f).join(b, "_i").withColumnRenamed("_v", f)
        rows.append((f, base, base - balanced_accuracy(predict(p), y, "prediction")))
    return df.sparkSession.createDataFrame(rows, "feature string, baseline double, importance double")


def leave_one_out(df: DataFrame, features: Sequence[str], y: str, test: DataFrame, seed: int = 42) -> DataFrame:
    """Change of balanced accuracy when a feature (or group of features) is left out of training."""
    full = balanced_accuracy(_forest(df, features, y, seed)(test), y, "prediction")
    rows = [(f, full, full - balanced_accuracy(_forest(df, [c for c in features if c != f], y, seed)(test), y, "prediction")) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, baseline double, loss double")

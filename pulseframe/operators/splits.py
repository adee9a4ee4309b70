"""Leakage-safe group splits.

Groups are never split. Only a histogram of group sizes, not the groups, is looked at on the
driver: groups of one class and size are interchangeable, so the greedy rule "largest group
to the lightest fold" is worked out per size and dealt to the groups by a hashed rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .sampling import hash_ranked

MAX_CELLS = 200_000


def class_counts(df: DataFrame, group: str, label: str, classes: Sequence) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)])


def _cells(g: DataFrame, n_classes: int) -> tuple[DataFrame, list]:
    """Stratum of a group (its rarest class) and weight (its count of that class); size histogram."""
    tot = g.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes)]).head() if n_classes else None
    order = sorted(range(n_classes), key=lambda i: (tot[f"c{i}"] or 0, i)) if n_classes else []
    stratum = F.coalesce(*[F.when(F.col(f"c{i}") > 0, F.lit(i)) for i in order], F.lit(-1)) if order else F.lit(-1)
    weight = F.coalesce(*[F.when(F.col(f"c{i}") > 0, F.col(f"c{i}")) for i in order], F.col("n")) if order else F.col("n")
    # sizes above 4096 are coarsened to 1/64 octave so that the histogram stays small
    w = F.when(weight <= 4096, weight).otherwise(F.ceil(F.exp(F.ceil(F.log(weight.cast("double")) * 92) / 92)))
    x = g.withColumn("_s", stratum).withColumn("_w", w.cast("long"))
    h = x.groupBy("_s", "_w").agg(F.count("*").alias("m"), F.sum("n").alias("rows"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes)])
    rows = h.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("too many distinct group sizes")
    rank = {s: k for k, s in enumerate(order + [-1])}
    return x, sorted(rows, key=lambda r: (rank[r["_s"]], -r["_w"]))


def _deal(rows: list, k: int, n_classes: int) -> list[tuple]:
    """Runs (stratum, weight, fold, first, last) of hashed ranks, lightest fold first."""
    load = [[0.0] * (n_classes + 1) for _ in range(k)]
    out = []
    for r in rows:
        s, m = r["_s"], r["m"]
        dim = s if s >= 0 else n_classes
        mean = [r[f"c{i}"] / m for i in range(n_classes)] + [r["rows"] / m]
        step = max(mean[dim], 1e-9)
        take = [0] * k
        left = m
        # level the folds analytically, then hand out what is left one by one
        base = sorted(range(k), key=lambda f: (load[f][dim], load[f][n_classes], f))
        if left > 4 * k:
            for _ in range(60):
                level = (sum(load[f][dim] for f in base) + left * step) / len(base)
                over = [f for f in base if load[f][dim] >= level]
                if not over:
                    break
                base = [f for f in base if f not in over]
            for f in base:
                take[f] = min(left, int((level - load[f][dim]) / step))
            left -= sum(take)
        heap = [(load[f][dim] + take[f] * step, load[f][n_classes], f) for f in range(k)]
        heapq.heapify(heap)
        for _ in range(left):
            a, b, f = heapq.heappop(heap)
            take[f] += 1
            heapq.heappush(heap, (a + step, b, f))
        at = 1
        for f in range(k):
            if take[f]:
                out.append((s, r["_w"], f, at, at + take[f] - 1))
                at += take[f]
                for i in range(n_classes + 1):
                    load[f][i] += mean[i] * take[f]
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, classes: Sequence, k: int = 5, seed: int = 42) -> DataFrame:
    """H1: (group, fold); whole groups, each class spread evenly, rarest class first."""
    g = class_counts(df, group, label, classes)
    return _assign(g, group, len(classes), k, seed)


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """H2: (group, fold); largest group to the lightest fold."""
    return _assign(df.groupBy(group).agg(F.count("*").alias("n")), group, 0, k, seed)


def _assign(g: DataFrame, group: str, n_classes: int, k: int, seed: int) -> DataFrame:
    x, rows = _cells(g, n_classes)
    runs = g.sparkSession.createDataFrame(_deal(rows, k, n_classes), "_s int, _w long, fold int, lo long, hi long")
    ranked = hash_ranked(x.select(group, "_s", "_w"), ["_s", "_w"], [group], seed)
    # at most MAX_CELLS * k runs, bounded by the histogram above
    return ranked.join(runs, ["_s", "_w"]).filter((F.col("rn") >= F.col("lo")) & (F.col("rn") <= F.col("hi"))).select(group, "fold")


def nested_folds(df: DataFrame, group: str, label: str, classes: Sequence, k: int = 5, inner: int = 4, base_seed: int = 42) -> DataFrame:
    """H3: (outer fold, group, role); inner folds of each outer train set, the first one validates."""
    outer = stratified_group_folds(df, group, label, classes, k, base_seed)
    out = None
    for f in range(k):
        train = df.join(outer.filter(F.col("fold") != f).select(group), group, "left_semi")
        i = stratified_group_folds(train, group, label, classes, inner, base_seed + f + 1)
        role = i.select(F.lit(f).alias("outer_fold"), group, F.when(F.col("fold") == 0, "inner_validation").otherwise("inner_train").alias("role"))
        test = outer.filter(F.col("fold") == f).select(F.lit(f).alias("outer_fold"), group, F.lit("outer_test").alias("role"))
        out = role.unionByName(test) if out is None else out.unionByName(role).unionByName(test)
    return out


def four_way(df: DataFrame, ident: str, labels: Sequence[str], shares: Sequence[float] = (0.8, 0.1, 0.05, 0.05), tolerance: float = 0.01, attempts: int = 20, seed: int = 42) -> DataFrame:
    """H4: hashed partition of records; the first seed whose class prevalences all stay close wins, else an error."""
    n = df.count()
    names = ["train", "validation", "calibration", "test"]
    cuts = [int(round(sum(shares[: i + 1]) * n)) for i in range(3)]
    for a in range(attempts):
        x = hash_ranked(df, [], [ident], seed + a)
        part = F.when(F.col("rn") <= cuts[0], names[0]).when(F.col("rn") <= cuts[1], names[1]).when(F.col("rn") <= cuts[2], names[2]).otherwise(names[3])
        x = x.withColumn("partition", part).drop("rn")
        p = x.groupBy("partition").agg(*[F.avg(c).alias(c) for c in labels])
        t = df.agg(*[F.avg(c).alias(f"t_{c}") for c in labels])
        worst = p.join(F.broadcast(t)).agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"t_{c}")) for c in labels], F.lit(0.0))).alias("w")).head()["w"]
        if worst is not None and worst <= tolerance:
            return x.withColumn("seed", F.lit(seed + a))
    raise ValueError("no seed keeps the prevalence deviation within the tolerance")


def record_split(df: DataFrame, ident: str, validation_share: float = 0.2, seed: int = 42) -> DataFrame:
    """H5: hashed record split with an exact validation size."""
    n = df.agg(F.floor(F.count("*") * validation_share).alias("_k"))
    x = hash_ranked(df, [], [ident], seed).join(F.broadcast(n))  # one row
    return x.withColumn("part", F.when(F.col("rn") <= F.col("_k"), "validation").otherwise("train")).drop("rn", "_k")


def resolve_identity(records: DataFrame, rules: DataFrame, same_patient: DataFrame) -> DataFrame:
    """H6: patient, role and status of each record.

    rules: (dataset, status, role) with status verified, grouped or unverified. A verified
    record takes the id of its header, documented groups share one id, an unverified data set
    becomes one conservative group, and a data set without a rule is quarantined.
    """
    x = records.join(F.broadcast(rules), "dataset", "left")  # one row per data set
    x = x.join(same_patient.select("dataset", "record_id", "patient_group"), ["dataset", "record_id"], "left")
    head = F.regexp_extract("header", r"(?i)patient[:=]\s*(\w+)", 1)
    own = F.when(F.col("patient_group").isNotNull(), F.concat_ws(":", "dataset", "patient_group"))
    verified = F.when((F.col("status") == "verified") & (head != ""), F.concat_ws(":", F.col("dataset"), head))
    grouped = F.when(F.col("status") == "grouped", F.concat_ws(":", F.col("dataset"), F.col("record_id").cast("string")))
    single = F.when(F.col("status") == "unverified", F.concat_ws(":", F.col("dataset"), F.lit("all")))
    pid = F.coalesce(own, verified, grouped, single)
    return x.select("dataset", "record_id", pid.alias("patient_id"), F.when(pid.isNull(), "quarantine").otherwise(F.col("role")).alias("role"), F.coalesce("status", F.lit("missing")).alias("identity_status"))


def attach_identity(rows: DataFrame, identity: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their patient and role; rows without an identity are returned apart."""
    return rows.join(identity, list(keys), "inner"), rows.join(identity, list(keys), "left_anti")


def crossing_groups(assign: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that appear in more than one fold."""
    return assign.select(group, fold).distinct().groupBy(group).agg(F.count("*").alias("n_folds")).filter("n_folds > 1")


def fold_shares(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Count and share of each class per fold."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    t = n.groupBy(*by).agg(F.sum("n").alias("_t"))
    return n.join(t, list(by)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def diagnostics(df: DataFrame, by: Sequence[str], group: str, label: str, classes: Sequence) -> DataFrame:
    """Rows, groups and class counts of every partition, with a hash of its groups."""
    c = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), *[F.count_if(F.col(label) == F.lit(v)).alias(f"n_{v}") for v in classes])
    # order-free digest: sum of per-group hashes, so groups are never listed in one place
    g = df.select(*by, group).distinct().withColumn("_h", F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long"))
    return c.join(g.groupBy(*by).agg(F.sum("_h").alias("groups_hash")), list(by))


def compare_schemes(schemes: dict[str, DataFrame], df: DataFrame, group: str, label: str, classes: Sequence, rare, k: int) -> DataFrame:
    """Q11: overlap, empty-class penalty and spread of the rare class per scheme; the best one is marked."""
    out = None
    for name, a in schemes.items():
        j = df.join(a, group)
        f = j.groupBy("fold").agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)], F.count_if(F.col(label) == F.lit(rare)).alias("r"))
        empty = sum((F.when(F.col(f"c{i}") == 0, 1).otherwise(0) for i in range(len(classes))), F.lit(0))
        s = f.agg(F.sum(empty).alias("empty_classes"), F.stddev_pop(F.col("r") / F.col("n")).alias("rare_spread"), (F.lit(k) - F.count("*")).alias("missing_folds"))
        o = crossing_groups(a, group).agg(F.count("*").alias("overlap"))
        row = s.join(F.broadcast(o)).withColumn("scheme", F.lit(name))  # one row each
        out = row if out is None else out.unionByName(row)
    key = F.struct("overlap", "empty_classes", F.round("rare_spread", 12), "scheme")
    best = out.agg(F.min(key).alias("_b"))
    return out.join(F.broadcast(best)).withColumn("chosen", F.col("scheme") == F.col("_b.scheme")).drop("_b")  # one row



"""Repeated nested cross-validation splits, leakage checks and split tables.

A split plan is one row per (trial, outer fold, row): role 'outer_test', or
'outer_train' with the inner fold in which the row is held out.  Rows are ordered
by md5 inside a stratum, so a plan can be rebuilt anywhere from its seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions.hashing import hash_bucket, hash_key
from cohortry.functions.ordering import row_index


def with_trials(df: DataFrame, trials: int) -> DataFrame:
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def stratified_folds(df: DataFrame, k: int, strata: Sequence[str], key: Column, name: str) -> DataFrame:
    """Deal the rows of each stratum round-robin in md5 order: fold 1..k."""
    d = row_index(df, strata, [key], hash_bucket(key), "__i", order_late=True)
    return d.withColumn(name, (1 + F.col("__i") % k).cast("int")).drop("__i")


def strat_kfold(df: DataFrame, k: int = 5, trials: int = 1, row: str = "row_id", y: str = "y") -> DataFrame:
    """(trial, outer_fold) per row; class shares per fold differ by at most one row."""
    d = with_trials(df, trials)
    return stratified_folds(d, k, ["trial", y], hash_key("outer", F.col("trial"), F.col(row)), "outer_fold")


def group_folds(
    df: DataFrame, k: int, cells: Sequence[str], seed: str, name: str, group: str = "group_id", y: str = "y"
) -> DataFrame:
    """Fold per (cells, group): groups of a label, largest first, dealt back and forth.

    All rows of a group share a fold.  Within a label the fold sizes in groups
    differ by at most one, and dealing by size evens the rows.
    """
    counts = df.groupBy(*cells, group, y).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*cells, group).agg(
        F.min_by(y, F.struct(-F.col("n"), F.col(y))).alias("__label"), F.sum("n").alias("__size")
    )
    d = groups.withColumn("__h", hash_key(seed, *[F.col(c) for c in cells], F.col(group)))
    bucket = F.struct(-F.col("__size"), hash_bucket(F.col("__h")))
    d = row_index(d, [*cells, "__label"], [-F.col("__size"), F.col("__h")], bucket, "__i")
    step = F.col("__i") % (2 * k)
    fold = F.when(step < k, step).otherwise(2 * k - 1 - step)
    return d.select(*cells, group, (1 + fold).cast("int").alias(name))


def strat_group_kfold(df: DataFrame, k: int = 5, trials: int = 1, group: str = "group_id", y: str = "y") -> DataFrame:
    """(trial, outer_fold) per row with every group in one fold of a trial."""
    d = with_trials(df, trials)
    return d.join(group_folds(d, k, ["trial"], "outer", "outer_fold", group, y), ["trial", group])


def nested_splits(
    df: DataFrame,
    outer: int = 5,
    inner: int = 3,
    trials: int = 1,
    row: str = "row_id",
    y: str = "y",
    group: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The full plan; with ``group``, no group crosses an outer or inner fold.  Columns to ``carry`` go along."""
    keep = [row, y] + ([group] if group else []) + list(carry)
    base = df.select(*keep)
    folds = strat_group_kfold(base, outer, trials, group, y) if group else strat_kfold(base, outer, trials, row, y)
    d = folds.withColumnRenamed("outer_fold", "test_fold")
    d = d.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(outer))))
    test = d.where("outer_fold = test_fold").withColumn("inner_fold", F.lit(None).cast("int"))
    train = d.where("outer_fold != test_fold")
    cells = ["trial", "outer_fold"]
    if group:
        train = train.join(group_folds(train, inner, cells, "inner", "inner_fold", group, y), [*cells, group])
    else:
        key = hash_key("inner", F.col("trial"), F.col("outer_fold"), F.col(row))
        train = stratified_folds(train, inner, [*cells, y], key, "inner_fold")
    both = test.withColumn("role", F.lit("outer_test")).unionByName(train.withColumn("role", F.lit("outer_train")))
    return both.select("trial", "outer_fold", "inner_fold", *keep, "role")


def inner_roles(splits: DataFrame, inner: int) -> DataFrame:
    """Expand a plan to inner_train / inner_val rows per inner fold."""
    d = splits.where("role = 'outer_train'").withColumnRenamed("inner_fold", "__val")
    d = d.withColumn("inner_fold", F.explode(F.sequence(F.lit(1), F.lit(inner))))
    role = F.when(F.col("inner_fold") == F.col("__val"), "inner_val").otherwise("inner_train")
    return d.withColumn("role", role).drop("__val")


# ------------------------------------------------------------------ checks


def leakage_check(splits: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups found on both sides, per outer fold and (inner) per held-out fold."""
    per = splits.groupBy("trial", "outer_fold", group).agg(
        F.max((F.col("role") == "outer_test").cast("int")).alias("t"),
        F.max((F.col("role") == "outer_train").cast("int")).alias("r"),
        F.count_distinct("inner_fold").alias("folds"),
    )
    return per.groupBy("trial", "outer_fold").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(F.col("t") * F.col("r")).alias("outer_leaks"),
        F.count_if(F.col("folds") > 1).alias("inner_leaks"),
    )


def coverage_check(splits: DataFrame, row: str = "row_id") -> DataFrame:
    """Per trial: rows, and rows not tested exactly once."""
    per = splits.groupBy("trial", row).agg(F.count_if(F.col("role") == "outer_test").alias("n_test"))
    return per.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_test") != 1).alias("n_bad_rows")
    )


def fold_label_stats(splits: DataFrame, y: str = "y") -> DataFrame:
    """Label counts and percent per fold and role."""
    counts = splits.groupBy("trial", "outer_fold", "role", y).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("trial", "outer_fold", "role"))
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def validate_splits(splits: DataFrame, outer: int, inner: int, trials: int, row: str = "row_id", group: str | None = None) -> None:
    """Raise on a wrong fold count, a row tested twice or never, or a leaking group."""
    shape = splits.groupBy("trial", "outer_fold").agg(F.max("inner_fold").alias("m"), F.min("inner_fold").alias("lo"))
    got = shape.agg(F.count(F.lit(1)).alias("folds"), F.max("m").alias("hi"), F.min("lo").alias("lo")).first()
    if got["folds"] != outer * trials:
        raise AssertionError(f"expected {outer * trials} (trial, fold) pairs, found {got['folds']}")
    if (got["lo"], got["hi"]) != (1, inner):
        raise AssertionError(f"inner folds run from {got['lo']} to {got['hi']}, expected 1 to {inner}")
    keys = splits.groupBy("trial", "outer_fold", row).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not keys.isEmpty():
        raise AssertionError(f"row listed twice in a fold: {keys.first()}")
    bad = coverage_check(splits, row).where("n_bad_rows > 0")
    if not bad.isEmpty():
        raise AssertionError(f"rows not tested exactly once: {bad.first()}")
    if group:
        leaks = leakage_check(splits, group).where("outer_leaks > 0 OR inner_leaks > 0")
        if not leaks.isEmpty():
            raise AssertionError(f"groups on both sides: {leaks.first()}")


# ------------------------------------------------------------------ tables


def split_sizes(splits: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows and unique groups per outer fold and role, with the mean held-out size."""
    size = splits.groupBy("trial", "outer_fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups")
    )
    inner = splits.where("role = 'outer_train'").groupBy("trial", "outer_fold", "inner_fold")
    inner = inner.agg(F.count(F.lit(1)).alias("n")).groupBy("trial", "outer_fold")
    inner = inner.agg(F.avg("n").alias("mean_inner_val"), F.avg(-F.col("n")).alias("__neg"))
    out = size.join(inner, ["trial", "outer_fold"])
    return out.select(
        "trial", "outer_fold", "role", "n_rows", "n_groups",
        F.when(F.col("role") == "outer_train", F.col("mean_inner_val")).alias("mean_inner_val"),
        F.when(F.col("role") == "outer_train", F.col("n_rows") + F.col("__neg")).alias("mean_inner_train"),
    )


def mixed_label_groups(df: DataFrame, group: str = "group_id", y: str = "y") -> DataFrame:
    """Groups whose rows carry more than one label."""
    per = df.groupBy(group).agg(F.count_distinct(y).alias("n_labels"), F.count(F.lit(1)).alias("n_rows"))
    return per.where("n_labels > 1")


def outer_class_percent(splits: DataFrame, labels: Sequence[int], y: str = "y") -> DataFrame:
    """Counts and percent per label as columns, one row per fold and role."""
    flags = [F.count_if(F.col(y) == v) for v in labels]
    n = F.count(F.lit(1))
    cols = [c.alias(f"n_{v}") for v, c in zip(labels, flags)]
    cols += [(100.0 * c / n).alias(f"percent_{v}") for v, c in zip(labels, flags)]
    return splits.groupBy("trial", "outer_fold", "role").agg(*cols)


def materialize_fold(df: DataFrame, splits: DataFrame, trial: int, outer_fold: int, row: str = "row_id") -> DataFrame:
    """Rows of one outer fold with their role and inner fold."""
    part = splits.where((F.col("trial") == trial) & (F.col("outer_fold") == outer_fold))
    return df.join(part.select(row, "role", "inner_fold"), row)


def split_manifest(splits: DataFrame) -> DataFrame:
    """Size of a plan, saved next to it."""
    return splits.agg(
        F.count_distinct("trial").alias("n_trials"),
        F.count_distinct("outer_fold").alias("n_outer_folds"),
        F.count_distinct("inner_fold").alias("n_inner_folds"),
        F.count_if(F.col("role") == "outer_test").alias("n_test_rows"),
        F.count_if(F.col("role") == "outer_train").alias("n_train_rows"),
    )

"""Choosing, joining and stacking feature tables; aggregation to one row per group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.ordering import BUCKET, by_group_size, grouped_quantiles, row_index, text_bucket
from cohortry.functions.rows import join_same, keep_first
from cohortry.operators.prep import unpivoted
from cohortry.table import FeatureTable

# --------------------------------------------------------------- columns


def keep_features(
    table: FeatureTable, n: int | None = None, names: Sequence[str] | None = None, strict: bool = True
) -> FeatureTable:
    """The first ``n`` features, or the named ones in the given order."""
    if (n is None) == (names is None):
        raise ValueError("give exactly one of n and names")
    if n is not None:
        chosen = list(table.features[:n])
    else:
        chosen = list(dict.fromkeys(names))
        unknown = [c for c in chosen if c not in table.features]
        if unknown and strict:
            raise KeyError(f"unknown features: {unknown}")
        chosen = [c for c in chosen if c in table.features]
    return table.with_features(table.df.select(*table.keys, *chosen), chosen)


def drop_features(table: FeatureTable, names: Sequence[str]) -> FeatureTable:
    """Without the named features; unknown names are ignored."""
    chosen = [c for c in table.features if c not in set(names)]
    return table.with_features(table.df.select(*table.keys, *chosen), chosen)


def ranked_names(ranking: DataFrame, features: Sequence[str], feature: str = "feature", rank: str = "rank") -> list[str]:
    """Feature names by rank after validating the ranking table."""
    missing = {feature, rank} - set(ranking.columns)
    if missing:
        raise KeyError(f"ranking lacks columns {sorted(missing)}")
    rows = ranking.select(feature, F.col(rank).cast("double").alias(rank)).limit(len(features) + 1).collect()
    ranks = [r[rank] for r in rows]
    if any(v is None or v != int(v) or v < 0 or v >= len(features) for v in ranks):
        raise ValueError("ranks must be integers within the number of features")
    names = [r[feature] for r in rows]
    if len(set(ranks)) != len(ranks) or len(set(names)) != len(names):
        raise ValueError("ranks and features must be unique")
    if unknown := [c for c in names if c not in features]:
        raise KeyError(f"unknown features: {unknown}")
    return [r[feature] for r in sorted(rows, key=lambda r: r[rank])]


def select_ranked(table: FeatureTable, ranking: DataFrame, top_k: int | None = None) -> FeatureTable:
    """Columns reordered by rank."""
    names = ranked_names(ranking, table.features)[:top_k]
    return table.with_features(table.df.select(*table.keys, *names), names)


def count_feature_columns(features: DataFrame, codes: DataFrame) -> DataFrame:
    """Number of columns whose name contains each code.

    Names are cut into the substrings as long as some code, which meet the codes by equality.
    """
    sizes = [r[0] for r in codes.select(F.length("code")).where("code is not null").distinct().collect()]  # lengths of codes
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("feature") - n + 1, F.lit(1))), lambda at: F.substring(F.col("feature"), at, F.lit(n)))
    parts = F.array_distinct(F.flatten(F.array(*[cuts(n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    named = features.where(F.col("feature").isNotNull()).select("feature", F.explode(parts).alias("code"))
    found = named.groupBy("code").agg(F.count("feature").alias("n_columns"))
    return codes.select("code").distinct().join(found, "code", "left").select("code", F.coalesce("n_columns", F.lit(0).cast("bigint")).alias("n_columns"))


# ------------------------------------------------------------ combine rows


def combine_families(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Join feature families side by side; every family must have the same keys."""
    out = frames[0]
    for other in frames[1:]:
        left, right = out.select(*keys).withColumn("__l", F.lit(1)), other.select(*keys).withColumn("__r", F.lit(1))
        odd = left.join(right, list(keys), "full").where(F.col("__l").isNull() | F.col("__r").isNull())
        if not odd.isEmpty():
            raise ValueError(f"feature families differ in their rows, e.g. {odd.select(*keys).first()}")
        out = out.join(other, list(keys))
    return out


def concat_left_aligned(first: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Columns of the others at the keys of the first; absent rows become null."""
    for other in others:
        first = first.join(other, list(keys), "left")
    return first


def common_features(presence: DataFrame, subject: str = "subject_id", feature: str = "feature") -> DataFrame:
    """Features every subject has, with their position in name order."""
    n = presence.agg(F.count_distinct(subject)).scalar()
    per = presence.groupBy(feature).agg(F.count_distinct(subject).alias("n_subjects"))
    return per.where(F.col("n_subjects") == n)


def missing_features(presence: DataFrame, subject: str = "subject_id", feature: str = "feature") -> DataFrame:
    """Per subject: features of the union it lacks (feature lists are schema sized)."""
    union = presence.agg(F.array_sort(F.collect_set(feature))).scalar()
    own = presence.groupBy(subject).agg(F.collect_set(feature).alias("own"))
    lacking = F.array_except(union, F.col("own"))
    d = own.withColumn("lacking", lacking).where(F.size("lacking") > 0)
    return d.select(subject, F.size("lacking").cast("bigint").alias("n_missing"), F.array_join("lacking", ",").alias("missing"))


def group_dimension(df: DataFrame, label: str = "label", subject: str = "subject_id") -> DataFrame:
    """(label, subject, group_id): groups numbered in label, subject order."""
    groups = df.select(label, subject).distinct()
    cut = lambda d: d.withColumn(BUCKET, F.struct(F.col(label), text_bucket(d, subject)))
    return row_index(groups, [], [F.col(label), F.col(subject).cast("string")], cut, "group_id")


def stack_groups(frames: Sequence[DataFrame], label: str = "label", subject: str = "subject_id") -> DataFrame:
    """Union per-subject frames and number the groups."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out.join(group_dimension(out, label, subject), [label, subject])


def label_map(df: DataFrame, label: str = "label", given: Mapping[str, int] | None = None) -> DataFrame:
    """Label ids in alphabetical order, or a given map checked for coverage."""
    found = df.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()
    if given is None:
        ids = row_index(found, [], [label], lambda d: d.withColumn(BUCKET, text_bucket(d, label)), "label_id")
        return ids.select(label, F.col("label_id").cast("int").alias("label_id"))
    if any(not isinstance(v, int) for v in given.values()) or len(set(given.values())) != len(given):
        raise ValueError("label ids must be unique integers")
    ids = df.sparkSession.createDataFrame(sorted(given.items()), f"{label} string, label_id int")
    if uncovered := [r[0] for r in found.join(ids, label, "left_anti").limit(10).collect()]:
        raise ValueError(f"labels without an id, among them: {sorted(uncovered)}")
    return ids


# ------------------------------------------------------------- subject joins


def subject_merge(left: DataFrame, right: DataFrame, key: str, order: str, how: str = "left") -> DataFrame:
    """One-to-one merge on a trimmed key: every left row stays, of the right the first row per key counts.

    A key that the left has twice is an error; rows without a key are kept unmatched.
    """
    a, b = (d.withColumn(key, F.trim(F.col(key).cast("string"))) for d in (left, right))
    if not a.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{key} occurs more than once on the left side")
    b = keep_first(b.where(F.col(key).isNotNull()), [key], [F.col(order)])
    return a.join(b.drop(order), key, how)


def merge_stats(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on each side and how many match."""
    norm = lambda d, flag: d.select(F.trim(F.col(key).cast("string")).alias("k"), F.lit(1).alias(flag)).distinct()
    both = norm(left, "l").join(norm(right, "r"), "k", "full")
    out = both.agg(
        F.count("l").alias("n_left"),
        F.count("r").alias("n_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_matched"),
    )
    return out.withColumns(
        {
            "n_left_only": F.col("n_left") - F.col("n_matched"),
            "n_right_only": F.col("n_right") - F.col("n_matched"),
            "match_rate": F.try_divide(F.col("n_matched").cast("double"), F.col("n_left").cast("double")),
        }
    )


def append_subject_covariates(
    rows: DataFrame,
    subjects: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    group: str = "group_id",
) -> DataFrame:
    """Encode the subject table, then add its columns to each of the subject's rows."""
    return rows.join(encode(subjects), group, "left")


# ------------------------------------------------------------ group aggregates

EXACT = {"sum": F.sum, "min": F.min, "max": F.max, "nanmean": F.avg}


def aggregate_groups(df: DataFrame, features: Sequence[str], how: str, group: str = "group_id") -> DataFrame:
    """One row per group.  'mean' and 'median' are null when a value is missing,
    'nanmean' and 'nanmedian' skip missing values."""
    if how in EXACT:
        aggs = [EXACT[how](c).alias(c) for c in features]
        return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    if how == "mean":
        full = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
        return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *[full(c).alias(c) for c in features])
    if how in ("median", "nanmedian"):
        rows = df.select(group, *features)
        return by_group_size(rows, [group], lambda d: _small_medians(d, features, how, group), lambda d: _large_medians(d, features, how, group))
    raise ValueError(f"unknown aggregation {how!r}")


def _small_medians(df: DataFrame, features: Sequence[str], how: str, group: str) -> DataFrame:
    """All columns in one grouping; a group's values fit a task."""
    value = lambda c: F.percentile(c, 0.5) if how == "nanmedian" else F.when(F.count(c) == F.count(F.lit(1)), F.percentile(c, 0.5))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *[value(c).alias(c) for c in features])


def _large_medians(df: DataFrame, features: Sequence[str], how: str, group: str) -> DataFrame:
    """A column after the other down the rows, each cut into ranges of its values."""
    medians = grouped_quantiles(unpivoted(df, features, [group]), [group, "feature"], "value", {"m": 0.5}, 0)
    wide = medians.groupBy(group).pivot("feature", list(features)).agg(F.struct(F.first("m").alias("m"), F.first("n").alias("n")))
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    d = join_same(size, wide, [group], "left")
    value = lambda c: F.col(c)["m"] if how == "nanmedian" else F.when(F.col(c)["n"] == F.col("n_rows"), F.col(c)["m"])
    return d.select(group, "n_rows", *[value(c).alias(c) for c in features])


def aggregate_groups_with(df: DataFrame, features: Sequence[str], agg: Callable[[str], Column], group: str = "group_id") -> DataFrame:
    """One row per group with a user-supplied column aggregate."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *[agg(c).alias(c) for c in features])


def group_label(df: DataFrame, group: str = "group_id", y: str = "y", how: str = "majority") -> DataFrame:
    """Label of a group: its only one, or the majority with ties to the smallest."""
    counts = df.groupBy(group, y).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(y, F.struct(-F.col("n"), F.col(y))).alias(y)
    out = counts.groupBy(group).agg(best, F.count(F.lit(1)).alias("n_labels"))
    if how == "unique":
        mixed = F.raise_error(F.concat(F.lit("more than one label in group "), F.col(group).cast("string")))
        out = out.withColumn(y, F.when(F.col("n_labels") > 1, mixed).otherwise(F.col(y)))
    return out


def group_gaps(df: DataFrame, group: str = "group_id") -> DataFrame:
    """Ids between 0 and the largest that no row has."""
    ids = df.select(F.col(group).cast("bigint").alias(group)).distinct()
    top = ids.agg(F.max(group)).first()[0]
    full = df.sparkSession.range(0, 0 if top is None else top + 1).select(F.col("id").alias(group))
    return full.join(ids, group, "left_anti")


# ------------------------------------------------------------- label folders


def folder_index(paths: DataFrame, label: Column, path: str = "path") -> DataFrame:
    """Label from the folder, id from the file stem, index within label and overall."""
    stem = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), -1), r"\.[^.]*$", "")
    d = paths.select(path, label.alias("label"), stem.alias("stem"))
    d = d.where(F.col("label").isNotNull() & (F.col("label") != ""))
    d = row_index(d, ["label"], [path], lambda x: x.withColumn(BUCKET, text_bucket(x, path)), "label_index")
    return row_index(d, [], ["label", path], lambda x: x.withColumn(BUCKET, F.struct(F.col("label"), text_bucket(x, path))), "global_index")

"""Pruning and ranking of features: constants, collinearity, VIF, rank aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from cohortry.functions.hashing import hash_bucket, hash_key, hash_mod
from cohortry.functions.ordering import row_index, value_runs
from cohortry.functions.rows import join_same
from cohortry.operators import gram, sweep
from cohortry.operators.prep import unpivoted
from cohortry.session import cut_lineage

VIF_CAP = 1e6


# --------------------------------------------------------------- constants


def constant_share(df: DataFrame, columns: Sequence[str], missing: str = "raise", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, top_share, n): share of the most frequent value per feature.

    ``missing``: 'include' counts null as a value, 'ignore' leaves nulls out,
    'raise' refuses them.
    """
    keys = list(keys)
    long = unpivoted(df, columns, keys)
    if missing == "ignore":
        long = long.where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    share = F.max("c") / F.sum("c")
    if missing == "raise":
        bad = F.raise_error(F.concat(F.lit("missing values in "), F.col("feature"))).cast("double")
        share = F.when(F.count_if(F.col("value").isNull()) > 0, bad).otherwise(share)
    return counts.groupBy(*keys, "feature").agg(share.alias("top_share"), F.sum("c").alias("n"))


def constant_features(df: DataFrame, columns: Sequence[str], tol: float = 1.0, missing: str = "raise") -> DataFrame:
    """Features whose most frequent value has a share of at least ``tol``."""
    if tol == 1.0 and missing != "include":
        # strictly constant: two running extremes instead of a count per value
        per = unpivoted(df, columns, []).groupBy("feature").agg(
            F.count("value").alias("n"), F.count(F.lit(1)).alias("rows"), (F.min("value") == F.max("value")).alias("c")
        )
        same = F.col("c")
        if missing == "raise":
            bad = F.raise_error(F.concat(F.lit("missing values in "), F.col("feature"))).cast("boolean")
            same = F.when(F.col("n") < F.col("rows"), bad).otherwise(same)
        return per.where(same).select("feature", F.lit(1.0).alias("top_share"), "n")
    return constant_share(df, columns, missing).where(F.col("top_share") >= tol)


def locally_constant_features(
    df: DataFrame,
    columns: Sequence[str],
    group: str = "group_id",
    min_rows: int = 2,
    local_frac: float = 1.0,
    tol: float = 1.0,
    missing: str = "raise",
) -> DataFrame:
    """Features constant within at least ``local_frac`` of the groups large enough to judge."""
    if tol >= 1.0 and missing != "include":
        # strictly constant: two running extremes instead of a count per value
        long = unpivoted(df, columns, [group])
        per = long.groupBy(group, "feature").agg(
            F.count("value").alias("n"), F.count(F.lit(1)).alias("rows"), (F.min("value") == F.max("value")).alias("c")
        )
        if missing == "raise":
            bad = F.raise_error(F.concat(F.lit("missing values in "), F.col("feature"))).cast("bigint")
            per = per.withColumn("n", F.when(F.col("n") < F.col("rows"), bad).otherwise(F.col("n")))
    else:
        per = constant_share(df, columns, missing, [group]).withColumn("c", F.col("top_share") >= tol)
    share = F.avg(F.coalesce("c", F.lit(False)).cast("double")).alias("constant_share")
    out = per.where(F.col("n") >= min_rows).groupBy("feature").agg(share, F.count(F.lit(1)).alias("n_groups"))
    return out.where(F.col("constant_share") >= local_frac)


def drop_constant(df: DataFrame, columns: Sequence[str], mode: str = "global", **options) -> list[str]:
    """Remaining columns; ``mode`` is global, local or both."""
    dropped: set[str] = set()
    if mode in ("global", "both"):
        picked = {k: v for k, v in options.items() if k in ("tol", "missing")}
        dropped |= {r["feature"] for r in constant_features(df, columns, **picked).select("feature").collect()}
    if mode in ("local", "both"):
        left = [c for c in columns if c not in dropped]
        dropped |= {r["feature"] for r in locally_constant_features(df, left, **options).select("feature").collect()}
    return [c for c in columns if c not in dropped]


# --------------------------------------------------------- one row per group


def bootstrap_rows(df: DataFrame, n_boot: int, seed: int = 0, group: str = "group_id", row: str = "row_id") -> DataFrame:
    """One uniformly drawn row per group and bootstrap.

    Rows of a group are numbered in md5 order; each (bootstrap, group) draws a
    number.  The draws of a group are one row, which goes where the group lies: the
    rows move once, to be numbered.
    """
    key = hash_key("order", F.col(row))
    d = row_index(df, [group], [key], hash_bucket(key), "__rn", order_late=True)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draws = draws.withColumn("__at", hash_mod(F.col("__n"), seed, F.col("boot"), F.col(group)))
    of = draws.groupBy(group, "__at").agg(F.collect_list("boot").alias("boots")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("__at", "boots"))).alias("__of"))
    boots = F.try_element_at("__of", F.col("__rn"))
    return d.join(of, [group]).select(group, *[c for c in df.columns if c != group], F.explode(boots).alias("boot"))


def one_row_per_group(df: DataFrame, seed: int = 0, group: str = "group_id", row: str = "row_id") -> DataFrame:
    return bootstrap_rows(df, 1, seed, group, row).drop("boot")


# ------------------------------------------------------------- correlation

#: Pairs that plain grouped sums take in one pass; beyond, pairs are tiles of a blocked Gram matrix, also in one.
NARROW = 150


def _pair_sums(a: Column, b: Column) -> dict[str, Column]:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return {"n": F.count(x), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(x * y)}


def _pairs_to_rows(sums: DataFrame, pairs, keys: Sequence[str]) -> DataFrame:
    cols = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"s{i}").alias("s"))
        for i, (a, b) in enumerate(pairs)
    ]
    return sums.select(*keys, F.inline(F.array(*cols)))


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Mean of every column, zero where there is none."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}


def is_narrow(columns: Sequence[str]) -> bool:
    return len(columns) * (len(columns) - 1) // 2 <= NARROW


def wide_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), values: Column | None = None) -> DataFrame:
    """Pearson r of every pair of any number of columns, from one scan (see ``gram``)."""
    r = gram.correlation(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return gram.pair_sums(df, columns, keys, values).select(*keys, "feature_a", "feature_b", r.alias("r"))


def pearson_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centers: Mapping[str, float] | None = None) -> DataFrame:
    """(keys, feature_a, feature_b, r) for a before b, over rows with both values.

    Map-side combined sums of products.  Values are centred on the column mean (or the
    given ``centers``) first, which leaves r unchanged and the sums small.
    """
    columns, keys = list(columns), list(keys)
    if not is_narrow(columns):
        return wide_pairs(df, columns, keys)
    means = column_means(df, columns) if centers is None else centers
    d = df.select(*keys, *[(F.col(c) - F.lit(means[c])).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs.append(F.struct(*[v.alias(k) for k, v in _pair_sums(F.col(a), F.col(b)).items()]).alias(f"s{i}"))
    out = _pairs_to_rows(d.groupBy(*keys).agg(*aggs), pairs, keys)
    r = gram.correlation(*[F.col("s")[k] for k in ("n", "x", "y", "xx", "yy", "xy")])
    return out.select(*keys, "feature_a", "feature_b", r.alias("r"))


#: Values of a column whose ranks are stored apart.
SHORT = 20_000


def average_ranks(df: DataFrame, columns: Sequence[str], row: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """The table with every value replaced by its average rank in its column (and keys).

    Ranks come from value runs per feature and are joined column by column on the value.  A
    column of few values meets a table as short as that, which Spark sends to the rows; rows
    move for columns of many values only, and without the row's id where no one asks for it.
    """
    keys, columns = list(keys), list(columns)
    runs = value_runs(unpivoted(df, columns, keys), [*keys, "feature"], "value")
    ranks = runs.select(*keys, "feature", "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    sizes = dict(ranks.groupBy("feature").agg(F.count(F.lit(1))).collect())  # a number per feature
    short = [c for c in columns if sizes.get(c, 0) <= SHORT]
    stored = ranks.where(F.col("feature").isin(short)).persist()
    stored.count()  # Spark then knows the size
    d = df.select(row, *keys, *[F.col(c).cast("double").alias(c) for c in columns])
    for i, c in enumerate(columns):
        of = (stored if c in short else ranks).where(F.col("feature") == c).select(*keys, F.col("value").alias(c), F.col("rank").alias(f"__rank{i}"))
        same = reduce(and_, [d[k].eqNullSafe(of[k]) for k in keys], d[c] == of[c])
        d = d.join(of, same, "left").select(*[d[x] for x in d.columns], of[f"__rank{i}"])
    d = d.where(F.coalesce(*columns).isNotNull())
    return d.select(row, *keys, *[F.col(f"__rank{i}").alias(c) for i, c in enumerate(columns)])


def rank_arrays(df: DataFrame, columns: Sequence[str], row: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """(row, keys, ranks): the average ranks of ``columns`` as one array, for tables too wide for a column each."""
    keys = list(keys)
    long = df.select(row, *keys, F.posexplode(gram.packed_columns(columns)).alias("position", "value"))
    runs = value_runs(long, [*keys, "position"], "value")
    ranks = runs.select(*keys, "position", "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    ranked = join_same(long, ranks, [*keys, "position", "value"], "left")
    # one entry for each column, so sorting by position puts every rank in its place
    entries = F.array_sort(F.collect_list(F.struct("position", "rank")))
    return ranked.groupBy(row, *keys).agg(F.transform(entries, lambda e: e["rank"]).alias("ranks"))


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], method: str = "spearman", row: str = "row_id", keys: Sequence[str] = ()
) -> DataFrame:
    """Correlation of every pair; Spearman is Pearson on average ranks.

    Where values are missing, each pair is ranked among the rows that have both.
    """
    if method == "pearson":
        return pearson_pairs(df, columns, keys)
    if method == "spearman":
        n, gaps = df.agg(F.count(F.lit(1)), F.count_if(has_gap(columns))).first()
        if gaps:
            return _spearman_complete(df, columns, row, keys)
        if not is_narrow(columns):
            return wide_pairs(rank_arrays(df, columns, row, keys), columns, keys, F.col("ranks"))
        # the mean rank of a whole column is known; within keys ranks are small
        middle = 0.0 if keys else (n + 1) / 2
        return pearson_pairs(average_ranks(df, columns, row, keys), columns, keys, centers=dict.fromkeys(columns, middle))
    if method == "kendall":
        from cohortry.operators.kendall import kendall_pairs

        return kendall_pairs(df, columns, keys=keys)
    raise ValueError(f"unknown correlation {method!r}")


def has_gap(columns: Sequence[str]) -> Column:
    """Does the row miss any of the values?"""
    return F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda gone: gone)


def _spearman_complete(df: DataFrame, columns: Sequence[str], row: str, keys: Sequence[str]) -> DataFrame:
    pair = lambda a, b: F.struct(
        F.lit(a).alias("__a"), F.lit(b).alias("__b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")
    )
    d = df.select(row, *keys, F.inline(F.array(*[pair(a, b) for a, b in combinations(columns, 2)])))
    d = d.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = average_ranks(d, ["x", "y"], row, [*keys, "__a", "__b"])
    r = pearson_pairs(ranked, ["x", "y"], [*keys, "__a", "__b"], centers={"x": 0.0, "y": 0.0})
    return r.select(*keys, F.col("__a").alias("feature_a"), F.col("__b").alias("feature_b"), "r")


# ------------------------------------------------------------ collinearity


def grouped_pairs(
    df: DataFrame, columns: Sequence[str], n_boot: int, method: str = "spearman", seed: int = 0, group: str = "group_id", row: str = "row_id"
) -> DataFrame:
    """Mean absolute correlation over samples of one row per group, which are stored: they are read several times."""
    sample = cut_lineage(bootstrap_rows(df.select(row, group, *columns), n_boot, seed, group, row))
    pairs = correlation_pairs(sample, columns, method, row, ["boot"])
    return pairs.groupBy("feature_a", "feature_b").agg(F.avg(F.abs("r")).alias("r"))


def collinear_pairs(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold).withColumn("r", F.abs("r"))


def greedy_prune(pairs: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> tuple[list[str], DataFrame]:
    """Keep a column, drop the later ones it is collinear with; returns kept and a log.

    Only pairs at or above the threshold reach the driver.
    """
    rows = collinear_pairs(pairs, threshold).select("feature_a", "feature_b", "r").collect()
    position = {c: i for i, c in enumerate(columns)}
    partners: dict[str, list] = {}
    for a, b, r in rows:
        first, second = sorted((a, b), key=position.__getitem__)
        partners.setdefault(first, []).append((second, r))
    removed: dict[str, tuple[str, float]] = {}
    for c in columns:
        if c in removed:
            continue
        for other, r in partners.get(c, []):
            removed.setdefault(other, (c, r))
    log = [(name, by, r) for name, (by, r) in removed.items()]
    frame = pairs.sparkSession.createDataFrame(log, "removed string, kept string, r double")
    return [c for c in columns if c not in removed], frame


# ------------------------------------------------------------------- VIF


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def correlation_states(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), centers: Mapping[str, float] | None = None
) -> DataFrame:
    """(keys, state): the correlation matrix of every group over its complete rows, one value a group."""
    columns, keys = list(columns), list(keys)
    place = {c: i for i, c in enumerate(columns)}
    pairs = pearson_pairs(complete_rows(df, columns), columns, keys, centers)
    group = [F.col(k) for k in keys] or [F.lit(0).alias("one")]
    fields = StructType([*[df.schema[k] for k in keys], StructField("state", BinaryType())])

    def matrix(found: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(len(columns))
        a, b = found["feature_a"].map(place).to_numpy(), found["feature_b"].map(place).to_numpy()
        m[a, b] = m[b, a] = found["r"].to_numpy()
        return pd.DataFrame({**{k: [found[k].iloc[0]] for k in keys}, "state": [sweep.pack(m, False)]})

    return pairs.groupBy(*group).applyInPandas(matrix, fields)


def mean_vif(states: DataFrame, gone: Sequence[int], cap: float = VIF_CAP) -> list[float]:
    """Mean VIF over all groups of the columns that are left once ``gone`` are dropped: as many numbers as columns."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for state in part["state"]:
                vif = sweep.vif(state, gone, cap)
                yield pd.DataFrame({"position": np.arange(len(vif)), "vif": vif})

    rows = states.select("state").mapInPandas(measure, "position int, vif double").groupBy("position").agg(F.avg("vif").alias("vif"))
    return [r["vif"] for r in rows.orderBy("position").collect()]


def vif_table(df: DataFrame, columns: Sequence[str], cap: float = VIF_CAP) -> DataFrame:
    """(feature, vif, tolerance), largest first, over rows without missing values."""
    columns = list(columns)
    vif = mean_vif(correlation_states(df, columns), [], cap) if len(columns) > 1 else [1.0] * len(columns)
    data = sorted(((c, float(v), float(1.0 / v)) for c, v in zip(columns, vif)), key=lambda t: (-t[1], t[0]))
    return df.sparkSession.createDataFrame(data, "feature string, vif double, tolerance double")


#: Drops that tasks repeat on the stored matrices before the shortened ones are stored in their place.
REFRESH = 24
VIF_LOG = "step int, removed string, vif double"


def eliminate(states: DataFrame, columns: Sequence[str], threshold: float, cap: float = VIF_CAP) -> tuple[list[str], list[tuple]]:
    """Drop the column of largest mean VIF while it is above the threshold.

    The matrices stay with the executors, inverted once; a drop takes a column out of the
    inverse by the sweep operator, and only the mean VIF of each column comes back.
    """
    left, gone, log = list(columns), [], []
    states = cut_lineage(states)
    while len(left) > 1:
        vif = mean_vif(states, gone, cap)
        if not vif:
            break
        worst = int(np.argmax(vif))
        if vif[worst] <= threshold:
            break
        log.append((len(log) + 1, left.pop(worst), float(vif[worst])))
        gone.append(worst)
        if len(gone) == REFRESH:
            states, gone = cut_lineage(_shortened(states, gone)), []
    return left, log


def vif_history(states: DataFrame, columns: Sequence[str], threshold: float, cap: float = VIF_CAP) -> DataFrame:
    """(keys, step, removed, vif): every group's own elimination, each in one task on its own matrix."""
    columns, keys = list(columns), [f for f in states.schema.fields if f.name != "state"]
    fields = StructType([*keys, StructField("step", IntegerType()), StructField("removed", StringType()), StructField("vif", DoubleType())])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                log = sweep.eliminated(row["state"], threshold, cap)
                if not log:  # an empty frame has no types that Arrow could take over
                    continue
                here = {f.name: [row[f.name]] * len(log) for f in keys}
                yield pd.DataFrame({**here, "step": range(1, len(log) + 1), "removed": [columns[k] for k, _ in log], "vif": [v for _, v in log]})

    return states.mapInPandas(work, fields)


def _shortened(states: DataFrame, gone: Sequence[int]) -> DataFrame:
    gone = list(gone)

    def shorten(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"state": [sweep.pack(*sweep.dropped(s, gone)) for s in part["state"]]})

    return states.select("state").mapInPandas(shorten, "state binary")


def vif_prune(df: DataFrame, columns: Sequence[str], threshold: float = 5.0, cap: float = VIF_CAP) -> tuple[list[str], DataFrame]:
    """Iterative elimination from one pass over the rows.

    With missing values the complete rows depend on the columns left, so the sums
    are taken again after a drop; without them every step works on the stored inverse.
    """
    kept, log = list(columns), []
    if df.where(has_gap(kept)).isEmpty():
        rows = vif_history(correlation_states(df, kept), kept, threshold, cap).orderBy("step").collect()
        log = [(r["step"], r["removed"], r["vif"]) for r in rows]
        gone = {r["removed"] for r in rows}
        return [c for c in kept if c not in gone], df.sparkSession.createDataFrame(log, VIF_LOG)
    while len(kept) > 1:
        vif = mean_vif(correlation_states(df, kept), [], cap)
        if not vif:
            break
        worst = int(np.argmax(vif))
        if vif[worst] <= threshold:
            break
        log.append((len(log) + 1, kept.pop(worst), float(vif[worst])))
    return kept, df.sparkSession.createDataFrame(log, VIF_LOG)


def vif_prune_grouped(
    df: DataFrame, columns: Sequence[str], n_boot: int, threshold: float = 5.0, cap: float = VIF_CAP, seed: int = 0, group: str = "group_id"
) -> tuple[list[str], DataFrame]:
    """Elimination by the mean VIF over samples of one row per group."""
    sample = cut_lineage(bootstrap_rows(df.select("row_id", group, *columns), n_boot, seed, group))
    kept, log = eliminate(correlation_states(sample, columns, ["boot"]), columns, threshold, cap)
    return kept, df.sparkSession.createDataFrame(log, VIF_LOG)


def prune_features(
    df: DataFrame,
    columns: Sequence[str],
    constant: Mapping | None = None,
    collinear: Mapping | None = None,
) -> tuple[list[str], dict[str, object]]:
    """Constant filter, then collinearity filter; ``None`` skips a step."""
    kept, logs = list(columns), {}
    if constant is not None:
        after = drop_constant(df, kept, **constant)
        logs["constant"] = [c for c in kept if c not in after]
        kept = after
    if collinear is not None:
        options = dict(collinear)
        threshold, n_boot = options.pop("threshold", 0.8), options.pop("n_boot", 0)
        pairs = grouped_pairs(df, kept, n_boot, **options) if n_boot else correlation_pairs(df, kept, **options)
        kept, logs["collinear"] = greedy_prune(pairs, kept, threshold)
    return kept, logs


# ------------------------------------------------------------------ ranks


def rank_scores(scores: DataFrame, keys: Sequence[str] = ("method",), score: str = "score") -> DataFrame:
    """0-based rank by absolute score, ties in feature order; a group is one score list."""
    order = W.partitionBy(*keys).orderBy(F.abs(F.coalesce(score, F.lit(0.0))).desc(), "feature")
    return scores.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))


def aggregate_ranks(ranks: DataFrame, top_k: int | None = None, rank: str = "rank") -> DataFrame:
    """Mean rank over methods, number of methods, the best ``top_k``."""
    out = ranks.groupBy("feature").agg(F.avg(rank).alias("mean_rank"), F.count(F.lit(1)).alias("n_methods"))
    out = out.orderBy("mean_rank", "feature")
    return out if top_k is None else out.limit(top_k)


Scorer = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


def mean_ranks(
    df: DataFrame, columns: Sequence[str], scorers: Mapping[str, Scorer], n_boot: int = 0, seed: int = 0, group: str = "group_id"
) -> DataFrame:
    """(method, feature, mean_rank): one full pass, or the mean over bootstraps."""
    if n_boot:
        return _mean_ranks(cut_lineage(bootstrap_rows(df, n_boot, seed, group)), columns, scorers, ["boot"])
    return _mean_ranks(df, columns, scorers, [])


def _mean_ranks(df: DataFrame, columns: Sequence[str], scorers: Mapping[str, Scorer], keys: list[str]) -> DataFrame:
    out = None
    for name, scorer in scorers.items():
        scores = scorer(df, columns, keys).select(*keys, "feature", "score").withColumn("method", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    ranked = rank_scores(out, [*keys, "method"])
    return ranked.groupBy("method", "feature").agg(F.avg("rank").alias("mean_rank"))


STAGE = {"methods": "ALL", "n_boot": 0, "top_k": 20, "seed": 0}


def rank_select(
    df: DataFrame,
    columns: Sequence[str],
    scorers: Mapping[str, Scorer],
    stages: Sequence[Mapping],
    group: str = "group_id",
) -> tuple[list[str], list[DataFrame]]:
    """Successive stages of ranking and selection; each stage overrides the defaults.

    Stages that draw alike (number of bootstraps and seed) share one stored sample.
    """
    kept, tables, samples = list(columns), [], {}
    for stage in stages:
        cfg = {**STAGE, **stage}
        methods = list(scorers) if cfg["methods"] == "ALL" else cfg["methods"]
        if unknown := [m for m in methods if m not in scorers]:
            raise KeyError(f"unknown methods: {unknown}")
        picked = {m: scorers[m] for m in methods}
        draw = cfg["n_boot"], cfg["seed"]
        if cfg["n_boot"] and draw not in samples:
            samples[draw] = cut_lineage(bootstrap_rows(df, *draw, group))
        ranks = _mean_ranks(samples.get(draw, df), kept, picked, ["boot"] if cfg["n_boot"] else [])
        table = aggregate_ranks(ranks.withColumnRenamed("mean_rank", "rank"), cfg["top_k"])
        rows = table.collect()  # at most top_k rows
        tables.append(df.sparkSession.createDataFrame(rows, table.schema))
        kept = [r["feature"] for r in rows]
    return kept, tables



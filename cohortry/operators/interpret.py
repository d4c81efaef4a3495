"""Permutation importance, partial dependence and shuffle stability.

``score`` maps a DataFrame to the same with a column ``p``: a fitted model's
transform or any column expression.  All altered copies of the rows are scored in
one pass, a block of features at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry.functions.curves import interp_grid, linspace
from cohortry.functions.hashing import hash_bucket, hash_key
from cohortry.functions.ordering import BUCKET, _offsets as offsets, column_quantiles, range_edges
from cohortry.functions.packed import RANGE_ROWS, packed_auroc
from cohortry.functions.shuffles import permuted_column, round_keys
from cohortry.operators.metrics import probability_metrics, ranking_metrics
from cohortry.operators.prep import unscale
from cohortry.session import cut_lineage

Score = Callable[[DataFrame], DataFrame]
LOWER_IS_BETTER = {"brier", "logloss"}
#: Rows that are permuted to place the edges between ranges of scores.
EDGE_ROWS = 100_000


def _metric(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """A value per key, worked out at once, so that the scores stored for it are released before the next are."""
    held: list[DataFrame] = []
    table = ranking_metrics(df, keys, held=held) if metric == "auprc" else probability_metrics(df, keys)
    out = cut_lineage(table.select(*keys, F.col(metric).alias("value")))
    for stored in held:
        stored.unpersist()
    return out


def _cell_values(df: DataFrame, metric: str, edges: Sequence[float]) -> dict[int, float]:
    """The metric of every numbered cell, larger is better; a cell without a value has none."""
    table = packed_auroc(df, edges).withColumnRenamed("auroc", "value") if metric == "auroc" else _metric(df, ["cell"], metric)
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    return {r["cell"]: sign * r["value"] for r in table.collect() if r["value"] is not None}  # a number per feature and repeat


@dataclass(frozen=True)
class Rows:
    """A table with row numbers 0..n-1 (column ``__r``); ``held`` is what is stored for it."""

    table: DataFrame
    n: int
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for stored in self.held:
            stored.unpersist()


def numbered(df: DataFrame, row: str = "row_id", keep: bool = True) -> Rows:
    """The table numbered in the order of a digest of the row's id, stored so that many permutations read one numbering.

    The digest cuts the rows into even ranges that are numbered side by side; only the
    sizes of the ranges are summed up in one place.  ``keep`` keeps the row's id.
    """
    key = hash_key("base", F.col(row))
    names = [c for c in df.columns if keep or c != row]
    d = df.select(*names, F.unhex(key).alias("__h"), F.conv(hash_bucket(key, 3), 16, 10).cast("int").alias(BUCKET))
    place = F.row_number().over(W.partitionBy(BUCKET).orderBy("__h"))
    local = d.select(*names, BUCKET, place.alias("__place")).persist()
    before = offsets(local.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n")), [], BUCKET, ["__n"])
    size = before.first()
    at = (F.col("__off___n") + F.col("__place") - 1).cast("bigint")
    return Rows(local.join(before, BUCKET).select(*names, at.alias("__r")), size["total___n"] if size else 0, (local, before))


def shuffled_copies(
    df: DataFrame, features: Sequence[str], repeats: Sequence[int], row: str = "row_id", seed: int = 0, rows: Rows | None = None
) -> DataFrame:
    """One copy of the rows per feature and repeat with that feature permuted.

    A repeat permutes the row numbers by a keyed bijection, the same for all features, so
    a row's values go straight to the row that receives them: nothing is sorted, and what
    is joined is one row of values per row and repeat.  ``rows`` are the rows where they
    are numbered already.
    """
    features, repeats = list(features), [int(r) for r in repeats]
    rows = rows or numbered(df, row)
    base, n = rows.table, rows.n
    keys = [round_keys(seed, r) for r in repeats]
    donated = base.select(F.posexplode(permuted_column(F.col("__r"), n, keys)).alias("__k", "__to"), *[F.col(c).cast("double").alias(f"__d{i}") for i, c in enumerate(features)])
    met = base.join(donated, F.col("__r") == F.col("__to"))
    names = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__d{i}").alias("donated")) for i, c in enumerate(features)])
    out = met.withColumn("repeat", F.get(F.array(*[F.lit(r) for r in repeats]), F.col("__k"))).select("*", F.inline(names))
    changed = {c: F.when(F.col("feature") == c, F.col("donated")).otherwise(F.col(c)) for c in features}
    return out.withColumns(changed).select(*[c for c in base.columns if c != "__r"], "feature", "repeat")


def _score_edges(rows: Rows, score: Score, features: Sequence[str], seed: int) -> list[float]:
    """Scores that cut the permuted rows into ranges of about ``RANGE_ROWS``, from rows permuted among about ``EDGE_ROWS``."""
    base, n = rows.table, rows.n
    ranges = -(-n // RANGE_ROWS)
    if ranges < 2:
        return []
    step = max(1, n // EDGE_ROWS)
    some = base.where(F.col("__r") % step == 0).withColumn("__r", F.expr(f"__r div {step}"))
    copies = score(shuffled_copies(base, features, [0], seed=seed, rows=Rows(some, -(-n // step))))
    return range_edges(copies.where("p is not null"), "p", ranges)


def perm_importance(
    df: DataFrame,
    score: Score,
    features: Sequence[str],
    n_repeats: int = 10,
    metric: str = "auroc",
    row: str = "row_id",
    seed: int = 0,
    block: int = 20,
    rows: Rows | None = None,
) -> DataFrame:
    """(feature, repeat, importance): loss of the metric when a feature is permuted.

    The score sees all columns but the row's id.  ``rows`` are the rows where they
    are numbered for other permutations as well.
    """
    features = list(features)
    placed = rows or numbered(df, row, keep=False)
    base, n = placed.table, placed.n
    edges = _score_edges(placed, score, features[:block], seed) if metric == "auroc" else []
    whole = _cell_values(score(base).withColumn("cell", F.lit(0)), metric, edges).get(0)
    found = []
    for start in range(0, len(features), block):
        names = features[start : start + block]
        copies = score(shuffled_copies(df, names, range(n_repeats), row, seed, placed))
        place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature")) - 1
        values = _cell_values(copies.withColumn("cell", (place * n_repeats + F.col("repeat")).cast("int")), metric, edges)
        for cell in range(len(names) * n_repeats if n else 0):
            value = values.get(cell)
            found.append((names[cell // n_repeats], cell % n_repeats, None if value is None or whole is None else whole - value))
    if rows is None:
        placed.release()
    return df.sparkSession.createDataFrame(found, "feature string, repeat int, importance double")


def perm_combined(folds: Mapping[tuple[int, int], DataFrame]) -> DataFrame:
    """Repeats of all folds together; folds that do not report the same features are an error."""
    out, named = None, None
    for cell, d in folds.items():
        here = {r["feature"] for r in d.select("feature").distinct().collect()}  # a name per feature
        if named is not None and here != named:
            raise ValueError(f"fold {cell} reports other features: {sorted(here ^ named)}")
        named = here
    for (trial, outer_fold), d in folds.items():
        d = d.withColumns({"trial": F.lit(trial), "outer_fold": F.lit(outer_fold)})
        out = d if out is None else out.unionByName(d)
    return out


def perm_ranked(combined: DataFrame, top_n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sd over all repeats, largest first."""
    keys = list(keys)
    d = combined.groupBy(*keys, "feature").agg(
        F.avg("importance").alias("mean"), F.coalesce(F.stddev_samp("importance"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n")
    )
    order = F.row_number().over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.col("mean").desc(), "feature"))
    d = d.withColumn("rank", order)
    return d if top_n is None else d.where(F.col("rank") <= top_n)


# -------------------------------------------------------- partial dependence


def pdp_grid(df: DataFrame, features: Sequence[str], resolution: int = 100, low: float = 0.05, high: float = 0.95) -> dict[str, list[float]]:
    """Unique values where there are fewer than ``resolution``, else even steps between two percentiles."""
    # a sketch rules out most columns; the rest are counted exactly up to the limit
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in features]).first()
    near = [c for c in features if rough[c] < 1.2 * resolution + 10]
    counts = {c: df.select(c).where(F.col(c).isNotNull()).distinct().limit(resolution).count() for c in near}
    few = [c for c in near if counts[c] < resolution]
    many = [c for c in features if c not in few]
    out = {c: sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in few}
    for c, (a, b) in column_quantiles(df, many, [low, high]).items():
        out[c] = linspace(a, b, resolution)
    return {c: [float(v) for v in out[c]] for c in features}


def partial_dependence(df: DataFrame, score: Score, grid: Mapping[str, Sequence[float]], keys: Sequence[str] = (), centered: bool = False) -> DataFrame:
    """(keys, feature, grid_index, grid, value): mean score with one feature set to each grid value."""
    keys, out = list(keys), None
    for feature, values in grid.items():
        points = F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(float(v)).alias("grid")) for i, v in enumerate(values)])
        copies = df.select("*", F.inline(points)).withColumn(feature, F.col("grid"))
        part = score(copies).groupBy(*keys, "grid_index", "grid").agg(F.avg("p").alias("value")).withColumn("feature", F.lit(feature))
        out = part if out is None else out.unionByName(part)
    if centered:
        first = W.partitionBy(*keys, "feature").orderBy("grid_index")
        out = out.withColumn("value", F.col("value") - F.first("value").over(first))
    return out.select(*keys, "feature", "grid_index", "grid", "value")


def pdp_long(pdp: DataFrame) -> DataFrame:
    """Only finite points."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return pdp.where(ok("grid") & ok("value"))


def pdp_mean(pdp: DataFrame, n_points: int = 50, max_unique: int = 10, fold: Sequence[str] = ("trial", "outer_fold")) -> DataFrame:
    """Fold curves on a shared grid per feature: mean and population sd."""
    fold = list(fold)
    spans = pdp.groupBy("feature").agg(
        F.count_distinct("grid").alias("n"), F.min("grid").alias("lo"), F.max("grid").alias("hi"), F.collect_set("grid").alias("values")
    )
    out = None
    for r in spans.collect():  # one row per feature, a grid long
        grid = sorted(r["values"]) if r["n"] <= max_unique else linspace(r["lo"], r["hi"], n_points)
        d = interp_grid(pdp.where(F.col("feature") == r["feature"]), ["feature", *fold], "grid", "value", grid)
        out = d if out is None else out.unionByName(d)
    return out.groupBy("feature", "grid_index", "grid").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n_folds")
    )


def pdp_report(folds: Mapping[tuple[int, int], tuple[DataFrame, Score]], features: Sequence[str], params: DataFrame | None = None, resolution: int = 100) -> DataFrame:
    """Fold curves of one model, their mean on a shared grid and, with ``params``, raw units."""
    out = None
    for (trial, outer_fold), (df, score) in folds.items():
        d = partial_dependence(df, score, pdp_grid(df, features, resolution))
        d = d.withColumns({"trial": F.lit(trial), "outer_fold": F.lit(outer_fold)})
        out = d if out is None else out.unionByName(d)
    mean = pdp_mean(pdp_long(out).persist())
    return mean if params is None else unscale(mean, params, "grid", "grid_raw")


# --------------------------------------------------------------- stability


def shuffle_drifts(
    df: DataFrame, scores: Mapping[str, Score], features: Sequence[str], seeds: Sequence[int], metric: str = "auroc", row: str = "row_id"
) -> DataFrame:
    """(model, seed, feature, drift): loss when one feature is shuffled once per seed."""
    out, rows = None, numbered(df, row, keep=False)
    for name, score in scores.items():
        for seed in seeds:
            d = perm_importance(df, score, features, 1, metric, row, seed, rows=rows)
            d = d.select(F.lit(name).alias("model"), F.lit(int(seed)).alias("seed"), "feature", F.col("importance").alias("drift"))
            out = d if out is None else out.unionByName(d)
    rows.release()
    return out

"""Recalibration of probabilities and calibration measures.

Logistic fits run as Newton steps: each step is one grouped sum over all groups at
once, on rows combined per (group, distinct score), and the coefficients of the groups
stay a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortry.functions.rows import join_same
from cohortry.functions.columns import clip, logit
from cohortry.functions.curves import linspace
from cohortry.functions.hashing import hash_wide, hash_wide_mod
from cohortry.functions.ordering import edge_bucket, grouped_quantiles, value_runs
from cohortry.session import cut_lineage

MODEL = ["model", "variant", "split"]
Features = Callable[[Column], list[Column]]


def platt_features(p: Column) -> list[Column]:
    """The raw probability, not its logit."""
    return [p]


def logit_features(p: Column) -> list[Column]:
    return [logit(p)]


def beta_features(p: Column, eps: float = 1e-12) -> list[Column]:
    q = clip(p, eps, 1.0 - eps)
    return [F.log(q), -F.log(1.0 - q)]


def score_cells(df: DataFrame, keys: Sequence[str], score: str = "p", y: str = "y") -> DataFrame:
    """(keys, p, n, pos): rows combined per distinct score."""
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(score).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")
    )


def _solved(h: dict[tuple[int, int], Column], g: list[Column]) -> list[Column]:
    """Solution of a symmetric 2 x 2 or 3 x 3 system in closed form (Cramer's rule)."""
    at = lambda i, j: h[min(i, j), max(i, j)]
    if len(g) == 2:
        det = at(0, 0) * at(1, 1) - at(0, 1) * at(0, 1)
        return [(at(1, 1) * g[0] - at(0, 1) * g[1]) / det, (at(0, 0) * g[1] - at(0, 1) * g[0]) / det]

    def minor(i: int, j: int) -> Column:
        (r, t), (u, v) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return (at(r, u) * at(t, v) - at(r, v) * at(t, u)) * (-1) ** (i + j)

    det = sum((at(0, j) * minor(0, j) for j in range(1, 3)), at(0, 0) * minor(0, 0))
    return [sum((minor(i, j) * g[j] for j in range(1, 3)), minor(i, 0) * g[0]) / det for i in range(3)]


def _newton(data: DataFrame, state: DataFrame, keys: list[str], width: int, tol: float, nonnegative: bool, small: bool) -> DataFrame:
    """One Newton step of every group that has not settled: a grouped sum, then a projection."""
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, width)]]
    known = [c for c in state.columns if c not in keys]
    d = join_same(data, F.broadcast(state) if small else state, keys) if keys else data.crossJoin(F.broadcast(state))
    eta = sum((F.col(f"b{i}") * x[i] for i in range(1, width)), F.col("b0"))
    d = d.withColumn("m", F.lit(1.0) / (1.0 + F.exp(-clip(eta, -500.0, 500.0))))
    w = F.col("n") * F.col("m") * (1.0 - F.col("m"))
    grad = [F.sum((F.col("pos") - F.col("n") * F.col("m")) * x[i]).alias(f"g{i}") for i in range(width)]
    hess = [F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(width) for j in range(i, width)]
    sums = d.groupBy(*keys, *known).agg(*grad, *hess)
    free = [F.lit(True), *[F.col(f"free{i}") for i in range(1, width)]]
    ridge = 1e-12 * sum((F.col(f"h{i}_{i}") for i in range(1, width)), F.col("h0_0"))
    h = {}
    for i in range(width):
        for j in range(i, width):
            own = F.col(f"h{i}_{j}") + ridge if i == j else F.col(f"h{i}_{j}")
            h[i, j] = F.when(free[i] & free[j], own).otherwise(1.0 if i == j else 0.0)
    steps = _solved(h, [F.when(free[i], F.col(f"g{i}")).otherwise(0.0) for i in range(width)])
    moved = sums.select(*keys, *known, *[s.alias(f"s{i}") for i, s in enumerate(steps)])
    reach = F.greatest(*[F.abs(f"s{i}") for i in range(width)])
    # the first steps of a near-separable group stay finite
    short = F.when(reach > 20, 20 / reach).otherwise(1.0)
    after = [F.when(F.col("done"), F.col(f"b{i}")).otherwise(F.col(f"b{i}") + F.col(f"s{i}") * short) for i in range(width)]
    moved = moved.select(*keys, "done", *[f"free{i}" for i in range(1, width)], *[a.alias(f"b{i}") for i, a in enumerate(after)], reach.alias("reach"))
    settled = F.col("reach") < tol * F.greatest(F.lit(1.0), *[F.abs(f"b{i}") for i in range(width)])
    if not nonnegative:
        return moved.select(*keys, *known[:-1], (F.col("done") | settled).alias("done"))
    lowest = F.least(*[F.when(F.col(f"free{i}"), F.col(f"b{i}")).otherwise(0.0) for i in range(1, width)], F.lit(0.0))
    fixed = lambda i: ~F.col("done") & settled & F.col(f"free{i}") & (F.col(f"b{i}") < 0) & (F.col(f"b{i}") == lowest)
    return moved.select(
        *keys,
        "b0", *[F.when(fixed(i), 0.0).otherwise(F.col(f"b{i}")).alias(f"b{i}") for i in range(1, width)],
        *[(F.col(f"free{i}") & ~fixed(i)).alias(f"free{i}") for i in range(1, width)],
        (F.col("done") | (settled & (lowest >= 0))).alias("done"),
    )


#: Newton steps between two looks at what has settled; groups whose coefficients (or runs whose places) are sent to all tasks at most.
ROUND = 4
SENT = 100_000
#: Slices of positions of a group whose runs are sent.
SLICES = 4096
#: Counts (runs times bootstraps, twice) that a task holds while it counts draws.
COUNTED = 1 << 22


def fit_logistic(
    cells: DataFrame,
    keys: Sequence[str],
    features: Features,
    names: Sequence[str],
    nonnegative: bool = False,
    max_iter: int = 30,
    tol: float = 1e-10,
) -> DataFrame:
    """Unpenalised logistic regression per key on (keys, p, n, pos) cells, any number of groups at once.

    Columns: keys, 'intercept', ``names`` and 'converged'; groups with one class are left
    out.  With ``nonnegative`` a negative slope is fixed at 0 and the rest refitted.  The
    coefficients are a table; a step sums over all groups and solves each in columns, so
    nothing but the number of unsettled groups is looked at outside.
    """
    keys = list(keys)
    xs = features(F.col("p"))
    width = len(xs) + 1
    data = cells.select(*keys, "n", "pos", *[x.alias(f"x{i}") for i, x in enumerate(xs, 1)]).persist()
    groups = data.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where("pos > 0 AND pos < n")
    start = [*[F.lit(0.0).alias(f"b{i}") for i in range(width)], *[F.lit(True).alias(f"free{i}") for i in range(1, width)], F.lit(False).alias("done")]
    state = cut_lineage(groups.select(*keys, *start))
    n_groups = state.count()
    left = max_iter * (2 if nonnegative else 1) if n_groups else 0
    while left > 0:
        for _ in range(min(ROUND, left)):
            state = _newton(data, state, keys, width, tol, nonnegative, n_groups <= SENT)
        left -= ROUND
        state = cut_lineage(state)
        if state.where(~F.col("done")).isEmpty():
            break
    data.unpersist()
    return state.select(*keys, F.col("b0").alias("intercept"), *[F.col(f"b{i}").alias(n) for i, n in enumerate(names, 1)], F.col("done").alias("converged"))


def apply_logistic(df: DataFrame, fits: DataFrame, keys: Sequence[str], features: Features, names: Sequence[str], score: str = "p") -> DataFrame:
    """Replace the score by the fitted probability of its group; null where the group has no fit (one class only)."""
    eta = sum((F.col(n) * x for n, x in zip(names, features(F.col(score)))), F.col("intercept"))
    d = join_same(df, fits, list(keys), "left")
    return d.withColumn(score, F.lit(1.0) / (1.0 + F.exp(-eta))).select(*df.columns)


FITS: dict[str, tuple[Features, list[str], bool]] = {
    "platt": (platt_features, ["slope"], False),
    "beta": (beta_features, ["a", "b"], True),
}


def recalibrate(oof: DataFrame, targets: DataFrame, method: str, keys: Sequence[str] = ("model", "trial", "outer_fold")) -> DataFrame:
    """Fit on out-of-fold training scores, apply to ``targets`` of the same fold."""
    features, names, nonnegative = FITS[method]
    fits = fit_logistic(score_cells(oof, keys), keys, features, names, nonnegative)
    return apply_logistic(targets, fits, keys, features, names).withColumn("variant", F.lit(method))


# ------------------------------------------------------- intercept and slope


def calibration_alpha_beta(df: DataFrame, keys: Sequence[str] = MODEL) -> DataFrame:
    """Calibration intercept and slope: logistic of y on logit(p)."""
    fits = fit_logistic(score_cells(df, keys), keys, logit_features, ["beta"])
    return fits.select(*keys, F.col("intercept").alias("alpha"), "beta")


def bootstrap_cells(
    df: DataFrame, keys: Sequence[str], boots: range, seed: int = 0, row: Sequence[str] = ("idx",), n_slices: int = 256
) -> DataFrame:
    """(keys, boot, p, n, pos) of samples with replacement, as large as the group.

    Every row draws, for each bootstrap, a position in its group sorted by (p, y).
    Positions are looked up in the runs of equal scores, both sides cut into slices
    of positions, so what is joined is draws against distinct scores, and what leaves
    is counts.  Up to ``SENT`` runs are sent to the draws, which then are counted where
    they are drawn; beyond that the draws of a position meet first.  Where a task can hold
    all counts, rows of several groups with one ``row`` share its digests.
    """
    keys = list(keys)
    runs = value_runs(df, keys, "p", {"n": F.lit(1).cast("bigint"), "pos": F.col("y").cast("bigint")})
    few = runs.agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(F.struct(*keys)).alias("groups")).first()
    sent = few["runs"] <= SENT
    if sent and 2 * few["runs"] * len(boots) <= COUNTED:
        return _counted_cells(df, runs, keys, boots, seed, row)
    if sent:
        n_slices = max(1, min(SLICES, 4 * SENT // max(1, few["groups"])))
    width = F.greatest(F.ceil(F.col("total_n") / n_slices), F.lit(1)).cast("bigint")
    cells = runs.select(
        *keys, "p", F.col("before_n").alias("lo"), (F.col("before_n") + F.col("n") - F.col("pos")).alias("mid"),
        (F.col("before_n") + F.col("n")).alias("hi"), width.alias("w"),
    )
    cells = cells.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor((F.col("hi") - 1) / F.col("w")))))
    sizes = runs.groupBy(*keys).agg(F.max("total_n").alias("total"))
    draws = df.where(F.col("p").isNotNull()).select(*keys, *row).join(sizes, keys)
    draws = draws.withColumn("boot", F.explode(F.sequence(F.lit(boots.start), F.lit(boots.stop - 1))))
    draws = draws.withColumn("u", hash_wide_mod(F.col("total"), seed, F.col("boot"), *[F.col(c) for c in row]))
    w = F.greatest(F.ceil(F.col("total") / n_slices), F.lit(1)).cast("bigint")
    # never null, so that the join does not take every digest once more to look for nulls
    draws = draws.select(*keys, "boot", "u", F.coalesce(F.floor(F.col("u") / w), F.lit(-1).cast("bigint")).alias("slice"))
    if sent:
        draws, cells = draws.withColumn("c", F.lit(1).cast("bigint")), F.broadcast(cells)
    else:
        draws = draws.groupBy(*keys, "boot", "u", "slice").agg(F.count(F.lit(1)).alias("c"))
    hit = draws.join(cells, [*keys, "slice"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return hit.groupBy(*keys, "boot", "p").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("u") >= F.col("mid"), F.col("c")).otherwise(0)).alias("pos")
    )


def _counted_cells(df: DataFrame, runs: DataFrame, keys: list[str], boots: range, seed: int, row: Sequence[str]) -> DataFrame:
    """``bootstrap_cells`` of few runs: a task looks its draws up in all of them and returns counts."""
    known = [r for r in runs.select(*keys, "p", "before_n", "n", "pos", "total_n").collect() if all(r[k] is not None for k in keys)]  # at most COUNTED
    known.sort(key=lambda r: r["before_n"])
    codes: dict[tuple, int] = {}
    of: list[list] = []
    for r in known:
        code = codes.setdefault(tuple(r[k] for k in keys), len(of))
        if code == len(of):
            of.append([])
        of[code].append(r)
    # a position belongs to slot 2i among the negatives of run i, to 2i + 1 among its positives
    edges = [np.array([[r["before_n"] + r["n"] - r["pos"], r["before_n"] + r["n"]] for r in rs], dtype=np.int64).ravel() for rs in of]
    totals, width = [rs[0]["total_n"] for rs in of], len(boots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(width * len(e), dtype=np.int64) for e in edges]
        for batch in batches:
            lists = batch.column("codes")
            flat, sizes = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
            wide = np.asarray(batch.column("wide").flatten()).reshape(-1, width)
            at = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            groups, starts = np.unique(flat[order], return_index=True)
            for code, lo, hi in zip(groups, starts, [*starts[1:], len(order)]):
                e = edges[code]
                slot = np.searchsorted(e, wide[at[order[lo:hi]]] % totals[code], side="right") + np.arange(width) * len(e)
                seen[code] += np.bincount(slot.ravel(), minlength=len(seen[code]))
        for code, c in enumerate(seen):
            both = c.reshape(width, -1, 2)
            boot, run = np.nonzero(both.sum(axis=2))
            n = len(boot)
            yield pa.record_batch([
                pa.array(np.full(n, code, dtype=np.int32)), pa.array(run.astype(np.int32)), pa.array((boot + boots.start).astype(np.int32)),
                pa.array(both[boot, run].sum(axis=1)), pa.array(both[boot, run, 1]),
            ], names=["code", "run", "boot", "n", "pos"])

    fields = [runs.schema[k] for k in keys]
    spark = df.sparkSession
    named = spark.createDataFrame([(*k, c) for k, c in codes.items()], StructType([*fields, StructField("code", IntegerType())]))
    places = [(*[r[k] for k in keys], r["p"], c, i) for c, rs in enumerate(of) for i, r in enumerate(rs)]
    placed = spark.createDataFrame(places, StructType([*fields, runs.schema["p"], StructField("code", IntegerType()), StructField("run", IntegerType())]))
    coded = df.where(F.col("p").isNotNull()).select(*keys, *row).join(F.broadcast(named), keys)  # at most as many as runs
    each = coded.groupBy(*row).agg(F.collect_list("code").alias("codes"))
    wide = F.array(*[hash_wide(seed, b, *[F.col(c) for c in row]) for b in boots])
    hit = each.select("codes", wide.alias("wide")).mapInArrow(count, "code int, run int, boot int, n bigint, pos bigint")
    hit = hit.groupBy("code", "run", "boot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return hit.join(placed, ["code", "run"]).select(*keys, "boot", "p", "n", "pos")


def calibration_bootstrap(df: DataFrame, keys: Sequence[str] = MODEL, n_boot: int = 500, seed: int = 0, row: Sequence[str] = ("idx",), chunk: int = 100) -> DataFrame:
    """Mean, sd and 95% interval of intercept and slope over bootstraps with both classes."""
    keys, fits = list(keys), None
    for start in range(0, n_boot, chunk):
        # draws depend on the bootstrap number alone, so chunks do not change them
        cells = bootstrap_cells(df, keys, range(start, min(n_boot, start + chunk)), seed, row)
        part = fit_logistic(cells, [*keys, "boot"], logit_features, ["beta"]).withColumnRenamed("intercept", "alpha")
        fits = part if fits is None else fits.unionByName(part)
    aggs = [F.count(F.lit(1)).alias("n_boot_used")]
    for c in ("alpha", "beta"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"),
            F.percentile(c, 0.025).alias(f"{c}_low"),
            F.percentile(c, 0.975).alias(f"{c}_high"),
        ]
    return fits.groupBy(*keys).agg(*aggs)


def pooled_stats(df: DataFrame, keys: Sequence[str] = MODEL, n_boot: int = 500, seed: int = 0, row: Sequence[str] = ("idx",)) -> DataFrame:
    """Size, event rate, intercept, slope and their bootstrap, folds pooled."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.count("y").alias("n"), F.avg(F.col("y").cast("double")).alias("event_rate"))
    return base.join(calibration_alpha_beta(df, keys), keys, "left").join(calibration_bootstrap(df, keys, n_boot, seed, row), keys, "left")


def param_table(stats: DataFrame, param: str = "beta", ideal: float = 1.0) -> DataFrame:
    """Methods by the distance of the bootstrap mean from the ideal value."""
    return stats.select(*MODEL, F.col(f"{param}_mean").alias("mean"), F.col(f"{param}_std").alias("sd")).withColumn(
        "distance", F.abs(F.col("mean") - F.lit(ideal))
    ).orderBy("distance", *MODEL)


# ------------------------------------------------------------ reliability


def with_bins(df: DataFrame, keys: Sequence[str], n_bins: int = 10, strategy: str = "uniform", score: str = "p") -> DataFrame:
    """Bin = number of interior edges below the score; an edge belongs to the lower bin."""
    if strategy == "uniform":
        return df.withColumn("bin", edge_bucket(F.col(score), linspace(0.0, 1.0, n_bins + 1)[1:-1]))
    if strategy == "quantile":
        qs = {f"q{i}": i / n_bins for i in range(1, n_bins)}
        edges = grouped_quantiles(df, keys, score, qs).select(*keys, F.array(*qs).alias("__e"))
        d = df.join(edges, list(keys))
        return d.withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(score)))).drop("__e")
    raise ValueError(f"unknown strategy {strategy!r}")


def reliability_curve(df: DataFrame, keys: Sequence[str] = MODEL, n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Mean score and event rate per nonempty bin with a normal 95% interval."""
    d = with_bins(df.where(F.col("p").isNotNull()), keys, n_bins, strategy).groupBy(*keys, "bin")
    d = d.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return d.withColumns({"low": clip(F.col("rate") - half, 0.0, 1.0), "high": clip(F.col("rate") + half, 0.0, 1.0)})


def score_histogram(df: DataFrame, keys: Sequence[str] = MODEL, n_bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """Scores per bin as counts and fractions."""
    keys = list(keys)
    counts = with_bins(df.where(F.col("p").isNotNull()), keys, n_bins, strategy).groupBy(*keys, "bin")
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__t"))
    return counts.join(total, keys).select(*keys, "bin", "n", (F.col("n") / F.col("__t")).alias("fraction"))

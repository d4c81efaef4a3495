"""Feature scores against a binary or categorical label.

Every scorer takes (df, columns, keys) and returns (keys, feature, score), so that
all bootstraps are scored in one job with the bootstrap number as a key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry.functions.ordering import column_quantiles, edge_bucket
from cohortry.operators.prep import unpivoted
from cohortry.operators.relief import relief_scores

N_BINS = 10


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str], y: str) -> DataFrame:
    return unpivoted(df, columns, [*keys, y]).where(F.col("value").isNotNull() & F.col(y).isNotNull())


def anova_f(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """One-way ANOVA F from count, mean and variance per (feature, label)."""
    keys = list(keys)
    per = _long(df, columns, keys, y).groupBy(*keys, "feature", y).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    total = per.groupBy(*keys, "feature").agg(grand.alias("__g"))
    d = per.join(total, [*keys, "feature"]).groupBy(*keys, "feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("__g")) * (F.col("m") - F.col("__g"))).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    f = F.try_divide(F.col("between") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return d.select(*keys, "feature", f.alias("score"))


def contingency(binned: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Cell counts with both margins per feature; at most bins x labels rows each."""
    counts = binned.groupBy(*keys, "feature", "bin", y).agg(F.count(F.lit(1)).alias("o"))
    over = lambda *c: W.partitionBy(*keys, "feature", *c)
    return counts.select(
        "*",
        F.sum("o").over(over("bin")).alias("row_n"),
        F.sum("o").over(over(y)).alias("col_n"),
        F.sum("o").over(over()).alias("n"),
    )


def equal_width_bins(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """Long table with the equal-width bin of each value between its extremes."""
    keys = list(keys)
    long = _long(df, columns, keys, y)
    span = long.groupBy(*keys, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    if keys:
        long = long.join(span, [*keys, "feature"])
    else:  # two numbers a feature; by a join all rows of a feature would meet in one task
        ends = [(F.lit(r["feature"]), F.array(F.lit(r["lo"]), F.lit(r["hi"]))) for r in span.collect()]
        at = F.create_map(*[x for pair in ends for x in pair])[F.col("feature")] if ends else F.array(F.lit(None), F.lit(None))
        long = long.withColumn("__at", at).withColumns({"lo": F.col("__at")[0], "hi": F.col("__at")[1]}).drop("__at")
    width = (F.col("hi") - F.col("lo")) / n_bins
    raw = F.floor(F.try_divide(F.col("value") - F.col("lo"), width))
    return long.withColumn("bin", F.coalesce(F.least(raw, F.lit(n_bins - 1)), F.lit(0)).cast("int"))


def chi2_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """Chi-square of (equal-width bin, label) and Cramer's V as the score."""
    t = contingency(equal_width_bins(df, columns, keys, y, n_bins), keys, y)
    expected = F.col("row_n") * F.col("col_n") / F.col("n")
    # sum over cells of (o - e)^2 / e = sum of o^2 / e minus n, empty cells included
    d = t.groupBy(*keys, "feature").agg(
        F.sum(F.col("o") * F.col("o") / expected).alias("s"),
        F.max("n").alias("n"),
        F.count_distinct("bin").alias("n_bins"),
        F.count_distinct(y).alias("n_labels"),
    )
    chi2 = F.col("s") - F.col("n")
    dof = F.least(F.col("n_bins"), F.col("n_labels")) - 1
    v = F.sqrt(F.greatest(F.try_divide(chi2, F.col("n") * dof), F.lit(0.0)))
    return d.select(*keys, "feature", chi2.alias("chi2"), "n", "n_bins", "n_labels", F.coalesce(v, F.lit(0.0)).alias("score"))


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf)(np.asarray(x) / math.sqrt(2.0)))


def _binned_normal_chi2(rho: float, nx: int, ny: int) -> float:
    """Chi-square per row of a bivariate normal cut into equal bins on [-5, 5]."""
    edges = [np.linspace(-5, 5, n + 1) if n > 2 else np.array([-5.0, 0.0, 5.0]) for n in (nx, ny)]
    outer = [np.concatenate(([-np.inf], e[1:-1], [np.inf])) for e in edges]
    px, py = (np.diff(_normal_cdf(o)) for o in outer)
    x = np.linspace(-6, 6, 2401)
    w = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * (x[1] - x[0])
    s = math.sqrt(max(1e-12, 1 - rho * rho))
    upper = np.stack([_normal_cdf((b - rho * x) / s) for b in outer[1][1:-1]]) if ny > 1 else np.zeros((0, len(x)))
    cond = np.diff(np.vstack([np.zeros(len(x)), upper, np.ones(len(x))]), axis=0)
    which = np.searchsorted(outer[0][1:-1], x, side="right")
    p = np.stack([[(cond[j] * w)[which == i].sum() for j in range(ny)] for i in range(nx)])
    e = np.outer(px, py)
    return float((((p - e) ** 2) / e).sum())


def phik_from_chi2(chi2: float, n: int, nx: int, ny: int) -> float:
    """Correlation of the binned normal whose chi-square matches, above the noise level."""
    if nx < 2 or ny < 2:
        return 0.0
    top, noise = n * (min(nx, ny) - 1), (nx - 1) * (ny - 1)
    if chi2 <= noise:
        return 0.0
    if chi2 >= top or top <= noise:
        return 1.0
    scale = (top - noise) / _binned_normal_chi2(0.9999, nx, ny)
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        if noise + scale * _binned_normal_chi2(min(mid, 0.9999), nx, ny) < chi2:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def phik_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """PhiK: chi-square in Spark, its inversion on one row per feature."""
    keys = list(keys)
    chi2 = chi2_scores(df, columns, keys, y, n_bins).drop("score")
    types = dict(chi2.dtypes)

    def invert(batches):
        for pdf in batches:
            cols = zip(pdf["chi2"], pdf["n"], pdf["n_bins"], pdf["n_labels"])
            yield pdf[[*keys, "feature"]].assign(score=[phik_from_chi2(c, int(n), int(a), int(b)) for c, n, a, b in cols])

    return chi2.mapInPandas(invert, "".join(f"{k} {types[k]}, " for k in keys) + "feature string, score double")


def mutual_info(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """Mutual information in nats of (quantile bin, label); edges from the whole columns."""
    keys = list(keys)
    quantiles = column_quantiles(df, columns, [i / n_bins for i in range(1, n_bins)])
    binned = [
        F.when(F.col(c).isNotNull(), edge_bucket(F.col(c), sorted(set(q for q in quantiles[c] if q is not None)))).alias(c)
        for c in columns
    ]
    long = unpivoted(df.select(*keys, y, *binned), columns, [*keys, y]).where(F.col("value").isNotNull())
    t = contingency(long.withColumnRenamed("value", "bin"), keys, y)
    o, n = F.col("o"), F.col("n")
    term = o / n * F.log(o * n / (F.col("row_n") * F.col("col_n")))
    return t.groupBy(*keys, "feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))


def _relief(variant: str):
    def scorer(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
        return relief_scores(df, columns, variant, keys=keys)

    return scorer


# MRMR is read for its relevance only, so FCQ and FCD (MIQ and MID) coincide.
SCORERS = {
    "phik": phik_scores,
    "fcq": anova_f,
    "fcd": anova_f,
    "miq": mutual_info,
    "mid": mutual_info,
    "relieff": _relief("relieff"),
    "surf": _relief("surf"),
    "surfstar": _relief("surfstar"),
    "multisurf": _relief("multisurf"),
    "multisurfstar": _relief("multisurfstar"),
}


# --------------------------------------------------------------- stability


def stability_summary(drifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (model, seed, feature, drift): per model and feature the drift's mean, sd,
    median and how often it reached the mean drift; over models mean and minimum."""
    mean_drift = drifts.groupBy("model", "seed").agg(F.avg("drift").alias("__m"))
    d = drifts.join(mean_drift, ["model", "seed"])
    per = d.groupBy("model", "feature").agg(
        F.avg("drift").alias("mean_drift"),
        F.coalesce(F.stddev_samp("drift"), F.lit(0.0)).alias("sd_drift"),
        F.median("drift").alias("median_drift"),
        F.avg((F.col("drift") >= F.col("__m")).cast("double")).alias("keep_freq"),
    )
    overall = per.groupBy("feature").agg(
        F.avg("mean_drift").alias("mean_drift"),
        F.avg("keep_freq").alias("mean_keep_freq"),
        F.min("keep_freq").alias("min_keep_freq"),
    )
    return per, overall


def top_features_per_model(scores: DataFrame, cutoffs: dict[str, int], default: int = 10, score: str = "mean_drift") -> DataFrame:
    """Best features of each model, with how many models list them."""
    limit = F.lit(default)
    for model, n in cutoffs.items():
        limit = F.when(F.col("model") == model, n).otherwise(limit)
    rank = F.row_number().over(W.partitionBy("model").orderBy(F.col(score).desc(), "feature"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= limit)
    shared = top.groupBy("feature").agg(F.count(F.lit(1)).alias("n_models"))
    return top.join(shared, "feature").select("model", "feature", "rank", score, "n_models")



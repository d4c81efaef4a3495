"""Discrimination metrics, curves and threshold choice over long predictions.

Scores are first combined into one row per (fold, distinct score); ranks and
curves are running sums over those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry.functions.columns import clip
from cohortry.functions.curves import interp_grid, linspace
from cohortry.functions.ordering import edge_bucket, value_runs

FOLD = ["model", "variant", "split", "trial", "outer_fold"]
MODEL = ["model", "variant", "split"]
LOG_EPS = 2.220446049250313e-16
METRICS = ["auroc", "auprc", "brier", "logloss"]


def score_runs(df: DataFrame, keys: Sequence[str], score: str = "p", y: str = "y", held: list[DataFrame] | None = None) -> DataFrame:
    """Per distinct score: rows ``n`` and positives ``pos`` with running sums."""
    n = F.lit(1).cast("bigint")
    return value_runs(df, keys, score, {"n": n, "pos": F.col(y).cast("bigint")}, held=held)


def ranking_metrics(df: DataFrame, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y", held: list[DataFrame] | None = None) -> DataFrame:
    """AUROC (average ranks on ties) and average precision; null for one class."""
    runs = score_runs(df, keys, score, y, held)
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    hits = F.col("total_pos") - F.col("before_pos")
    called = F.col("total_n") - F.col("before_n")
    d = runs.groupBy(*keys).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("n_pos"),
        F.sum(F.col("pos") * rank).alias("__ranks"),
        F.sum(F.col("pos") * hits / called).alias("__gain"),
    )
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    both = (pos > 0) & (neg > 0)
    return d.select(
        *keys,
        "n",
        "n_pos",
        F.when(both, F.try_divide(F.col("__ranks") - pos * (pos + 1) / 2, pos * neg)).alias("auroc"),
        F.when(both, F.try_divide(F.col("__gain"), pos)).alias("auprc"),
    )


def probability_metrics(df: DataFrame, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y") -> DataFrame:
    """Brier score, clipped log loss and prevalence."""
    p, t = F.col(score), F.col(y)
    q = clip(p, LOG_EPS, 1.0 - LOG_EPS)
    return df.groupBy(*keys).agg(
        F.avg((p - t) * (p - t)).alias("brier"),
        F.avg(-F.when(t == 1, F.log(q)).otherwise(F.log(1.0 - q))).alias("logloss"),
        F.avg(t.cast("double")).alias("prevalence"),
    )


def fold_metrics(df: DataFrame, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y") -> DataFrame:
    """All metrics of every fold, variant and split."""
    return ranking_metrics(df, keys, score, y).join(probability_metrics(df, keys, score, y), list(keys))


def metric_baselines(prevalence: DataFrame, column: str = "prevalence") -> DataFrame:
    """What a constant prediction of the prevalence scores."""
    p = F.col(column)
    entropy = F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)
    return prevalence.withColumns(
        {"base_auroc": F.lit(0.5), "base_auprc": p, "base_brier": p * (1 - p), "base_logloss": entropy}
    )


def metric_long(metrics: DataFrame, keys: Sequence[str] = FOLD, names: Sequence[str] = METRICS) -> DataFrame:
    """One row per fold and metric."""
    return metrics.select(*keys, *names).unpivot(list(keys), list(names), "metric", "value")


def metric_summary(long: DataFrame, keys: Sequence[str] = (*MODEL, "metric")) -> DataFrame:
    """Mean and sample sd over folds; the sd of a single fold is 0."""
    n = F.count("value")
    sd = F.when(n > 1, F.stddev_samp("value")).when(n == 1, 0.0)
    return long.groupBy(*keys).agg(F.avg("value").alias("mean"), sd.alias("sd"), n.alias("n_folds"))


def method_order(summary: DataFrame, higher_is_better: bool = True, method: str = "model") -> DataFrame:
    """Position of each method by its mean, within everything else."""
    rest = [c for c in summary.columns if c not in (method, "mean", "sd", "n_folds")]
    mean = F.col("mean").desc() if higher_is_better else F.col("mean").asc()
    position = F.row_number().over(W.partitionBy(*rest).orderBy(mean, method))
    return summary.withColumn("position", position.cast("bigint"))


def metric_over_trials(long: DataFrame) -> DataFrame:
    """Mean per trial and split."""
    return long.groupBy(*MODEL, "trial", "metric").agg(F.avg("value").alias("mean"))


# ------------------------------------------------------------------ curves


def roc_curve(df: DataFrame, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, calling p >= threshold positive."""
    runs = score_runs(df, keys, score, y)
    tp = F.col("total_pos") - F.col("before_pos")
    fp = F.col("total_n") - F.col("before_n") - tp
    neg = F.col("total_n") - F.col("total_pos")
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return runs.select(*keys, F.col(score).alias("threshold"), rate(fp, neg).alias("fpr"), rate(tp, F.col("total_pos")).alias("tpr"))


def pr_curve(df: DataFrame, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y") -> DataFrame:
    """(threshold, recall, precision) per distinct score."""
    runs = score_runs(df, keys, score, y)
    tp = (F.col("total_pos") - F.col("before_pos")).cast("double")
    called = (F.col("total_n") - F.col("before_n")).cast("double")
    recall = F.try_divide(tp, F.col("total_pos").cast("double"))
    return runs.select(*keys, F.col(score).alias("threshold"), recall.alias("recall"), (tp / called).alias("precision"))


def _fold_mean(interpolated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return interpolated.groupBy(*keys, "grid_index", "grid").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n_folds")
    )


def mean_roc(df: DataFrame, n_points: int = 101, keys: Sequence[str] = FOLD, over: Sequence[str] = ("trial", "outer_fold")) -> DataFrame:
    """Fold curves on a shared grid, ends pinned to 0 and 1, mean and population sd."""
    curve = roc_curve(df, keys)
    at = interp_grid(curve, keys, "fpr", "tpr", linspace(0.0, 1.0, n_points), tie="tpr")
    value = F.when(F.col("grid_index") == 0, 0.0).when(F.col("grid_index") == n_points - 1, 1.0).otherwise(F.col("value"))
    return _fold_mean(at.withColumn("value", value), [k for k in keys if k not in over])


def mean_pr(df: DataFrame, n_points: int = 101, keys: Sequence[str] = FOLD, over: Sequence[str] = ("trial", "outer_fold")) -> DataFrame:
    """Precision at a shared recall grid; at equal recall the lowest precision counts."""
    curve = pr_curve(df, keys).select(*keys, "recall", "precision")
    end = curve.select(*keys).distinct().select(*keys, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    curve = curve.unionByName(end).withColumn("__tie", -F.col("precision"))
    at = interp_grid(curve, keys, "recall", "precision", linspace(0.0, 1.0, n_points), tie="__tie")
    return _fold_mean(at, [k for k in keys if k not in over])


# ------------------------------------------------------- balanced accuracy


def bacc_curve(df: DataFrame, n_thresholds: int = 101, keys: Sequence[str] = FOLD, score: str = "p", y: str = "y") -> DataFrame:
    """Balanced accuracy at each threshold of a grid.

    Rows are counted per interval between thresholds; only those counts (one row
    per fold and interval) are summed along the grid.
    """
    keys = list(keys)
    grid = [i / (n_thresholds - 1) for i in range(n_thresholds)]
    counts = df.groupBy(*keys, edge_bucket(F.col(score), grid, inclusive=True).alias("cell")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    frame = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_thresholds))).alias("cell"))
    d = frame.join(counts, [*keys, "cell"], "left")
    upward = W.partitionBy(*keys).orderBy(F.col("cell").desc())
    group = W.partitionBy(*keys)
    d = d.select(
        *keys,
        (F.col("cell") - 1).alias("t_index"),
        F.sum(F.coalesce("pos", F.lit(0))).over(upward).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(upward).alias("fp"),
        F.sum("pos").over(group).alias("n_pos"),
        F.sum("neg").over(group).alias("n_neg"),
    ).where("t_index >= 0")
    threshold = F.get(F.array(*[F.lit(g) for g in grid]), F.col("t_index"))
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("n_pos").cast("double"))
    tnr = F.try_divide((F.col("n_neg") - F.col("fp")).cast("double"), F.col("n_neg").cast("double"))
    return d.select(*keys, "t_index", threshold.alias("threshold"), ((tpr + tnr) / 2).alias("bacc"))


def best_threshold(curve: DataFrame, keys: Sequence[str] = FOLD) -> DataFrame:
    """First threshold with the highest balanced accuracy (compared to 12 decimals)."""
    order = F.struct(-F.round("bacc", 12), F.col("t_index"))
    best = curve.groupBy(*keys).agg(F.min_by(F.struct("t_index", "threshold", "bacc"), order).alias("b"))
    return best.select(*keys, "b.*")


def bacc_at_choice(curve: DataFrame, choose: str = "train", train: str = "train", test: str = "test") -> DataFrame:
    """Balanced accuracy per fold and split at a threshold chosen on one split.

    ``choose`` is a split name whose best threshold is applied to both splits, or
    'each' for every split's own best.
    """
    fold = [c for c in FOLD if c != "split"]
    curve = curve.persist()  # a grid per fold, read twice
    if choose == "each":
        return best_threshold(curve)
    best = best_threshold(curve.where(F.col("split") == choose)).select(*fold, "t_index")
    return curve.where(F.col("split").isin(train, test)).join(best, [*fold, "t_index"]).select(*FOLD, "t_index", "threshold", "bacc")


def bacc_summary(chosen: DataFrame) -> DataFrame:
    """Mean and sample sd of balanced accuracy and threshold over folds."""
    return chosen.groupBy(*MODEL).agg(
        F.avg("bacc").alias("bacc_mean"),
        F.coalesce(F.stddev_samp("bacc"), F.lit(0.0)).alias("bacc_sd"),
        F.avg("threshold").alias("threshold_mean"),
        F.coalesce(F.stddev_samp("threshold"), F.lit(0.0)).alias("threshold_sd"),
        F.count(F.lit(1)).alias("n_folds"),
    )


# ---------------------------------------------------------------- patients


def patient_metrics(patients: DataFrame, score: str, keys: Sequence[str] = MODEL) -> DataFrame:
    """AUROC and average precision over patients."""
    return ranking_metrics(patients, keys, score)



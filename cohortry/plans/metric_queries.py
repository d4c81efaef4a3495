"""Metrics and curves over the long predictions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import metrics as m
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.risk_queries import median_patients, patients_sql
from cohortry.plans.views import V, with_views

K = "model, variant, split, trial, outer_fold"
M = "model, variant, split"


def rank_sql(src: str, keys: str, score: str) -> str:
    """CTEs ``au`` (AUROC) and ``ap`` (average precision)."""
    return f"""rk AS (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {score})
        + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS r FROM {src}),
      au AS (SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN
        (sum(r) FILTER (y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc FROM rk GROUP BY {keys}),
      sc AS (SELECT {keys}, {score} AS s, count(*) AS c, sum(y)::DOUBLE AS pos FROM {src} GROUP BY ALL),
      cu AS (SELECT {keys}, s, pos, sum(pos) OVER w AS tp, sum(c)::DOUBLE OVER w AS called, sum(pos) OVER (PARTITION BY {keys}) AS tot
        FROM sc WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC)),
      ap AS (SELECT {keys}, sum(pos / tot * tp / called) AS auprc FROM cu WHERE tot > 0 GROUP BY {keys})""".replace(
        "sum(c)::DOUBLE OVER w", "CAST(sum(c) OVER w AS DOUBLE)"
    )


PROB = f"""pb AS (SELECT {K}, avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
    ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END) AS logloss, avg(y::DOUBLE) AS prevalence FROM pred GROUP BY ALL)"""
FM = f"""{rank_sql('pred', K, 'p')}, {PROB},
  ml AS (SELECT {K}, metric, value FROM (SELECT {K}, auroc, auprc, brier, logloss FROM au JOIN ap USING ({K}) JOIN pb USING ({K}))
    UNPIVOT INCLUDE NULLS (value FOR metric IN (auroc, auprc, brier, logloss)))"""


def predictions(spark, folder):
    return V(spark, folder).predictions()


def fold_long(spark, folder):
    return m.metric_long(m.fold_metrics(predictions(spark, folder)))


def _rounded(d, names, digits=6):
    return d.withColumns({c: r6(F.col(c), digits) for c in names})


@query("auroc_by_fold", with_views("pred", f"SELECT {K}, n, n_pos, {R('auroc')} AS auroc FROM au", rank_sql("pred", K, "p")))
def auroc_by_fold(spark, folder):
    return _rounded(m.ranking_metrics(predictions(spark, folder)).drop("auprc"), ["auroc"])


@query("auprc_by_fold", with_views("pred", f"SELECT {K}, {R('auprc')} AS auprc FROM ap", rank_sql("pred", K, "p")))
def auprc_by_fold(spark, folder):
    return _rounded(m.ranking_metrics(predictions(spark, folder)).select(*m.FOLD, "auprc"), ["auprc"])


@query("brier_by_fold", with_views("pred", f"SELECT {K}, {R('brier')} AS brier, {R('prevalence')} AS prevalence FROM pb", PROB))
def brier_by_fold(spark, folder):
    d = m.probability_metrics(predictions(spark, folder))
    return _rounded(d.select(*m.FOLD, "brier", "prevalence"), ["brier", "prevalence"])


@query("logloss_by_fold", with_views("pred", f"SELECT {K}, {R('logloss')} AS logloss FROM pb", PROB))
def logloss_by_fold(spark, folder):
    return _rounded(m.probability_metrics(predictions(spark, folder)).select(*m.FOLD, "logloss"), ["logloss"])


@query(
    "metric_baselines",
    with_views(
        "pred",
        f"""SELECT {K}, {R('prevalence')} AS prevalence, 0.5::DOUBLE AS base_auroc, {R('prevalence')} AS base_auprc,
          {R('prevalence * (1 - prevalence)')} AS base_brier,
          {R('-(prevalence * ln(prevalence) + (1 - prevalence) * ln(1 - prevalence))')} AS base_logloss FROM pb""",
        PROB,
    ),
)
def metric_baselines(spark, folder):
    d = m.metric_baselines(m.probability_metrics(predictions(spark, folder)).select(*m.FOLD, "prevalence"))
    return _rounded(d, ["prevalence", "base_auprc", "base_brier", "base_logloss"])


@query("metric_long", with_views("pred", f"SELECT {K}, metric, {R('value')} AS value FROM ml", FM))
def metric_long(spark, folder):
    return _rounded(fold_long(spark, folder), ["value"])


@query(
    "metric_summary",
    with_views("pred", f"SELECT {M}, metric, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, count(value) AS n_folds FROM ml GROUP BY ALL", FM),
)
def metric_summary(spark, folder):
    return _rounded(m.metric_summary(fold_long(spark, folder)), ["mean", "sd"])


@query(
    "method_order",
    with_views(
        "pred",
        f"""SELECT {M}, {R('mean')} AS mean, row_number() OVER (PARTITION BY variant, split ORDER BY mean DESC, model) AS position
          FROM (SELECT {M}, avg(value) AS mean FROM ml WHERE metric = 'auroc' GROUP BY ALL)""",
        FM,
    ),
)
def method_order(spark, folder):
    d = m.metric_summary(fold_long(spark, folder).where("metric = 'auroc'"), m.MODEL)
    return _rounded(m.method_order(d).select(*m.MODEL, "mean", "position"), ["mean"])


@query(
    "metric_over_trials",
    with_views("pred", f"SELECT {M}, trial, metric, {R('avg(value)')} AS mean FROM ml GROUP BY ALL", FM),
)
def metric_over_trials(spark, folder):
    return _rounded(m.metric_over_trials(fold_long(spark, folder)), ["mean"])


CURVE = f"""sc AS (SELECT {K}, p, count(*) AS c, sum(y) AS pos FROM pred GROUP BY ALL),
  cv AS (SELECT {K}, p, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(c - pos) OVER w AS DOUBLE) AS fp,
    CAST(sum(pos) OVER (PARTITION BY {K}) AS DOUBLE) AS np, CAST(sum(c - pos) OVER (PARTITION BY {K}) AS DOUBLE) AS nn
    FROM sc WINDOW w AS (PARTITION BY {K} ORDER BY p DESC))"""


@query("roc_curve", with_views("pred", f"SELECT {K}, p AS threshold, {R('fp / nn')} AS fpr, {R('tp / np')} AS tpr FROM cv", CURVE))
def roc_curve(spark, folder):
    return _rounded(m.roc_curve(predictions(spark, folder)), ["fpr", "tpr"])


@query("pr_curve", with_views("pred", f"SELECT {K}, p AS threshold, {R('tp / np')} AS recall, {R('tp / (tp + fp)')} AS precision FROM cv", CURVE))
def pr_curve(spark, folder):
    return _rounded(m.pr_curve(predictions(spark, folder)), ["recall", "precision"])


def interp_sql(src: str, x: str, y: str, last: str, first: str) -> str:
    """Interpolated fold curves; ``last``/``first`` pick among points of equal x."""
    return f"""gr AS (SELECT CAST(r AS INTEGER) AS i, r / 20.0::DOUBLE AS g FROM range(21) t(r)),
      ip AS (SELECT {K}, i, g, CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL THEN ly ELSE ly + (ry - ly) / (rx - lx) * (g - lx) END AS v FROM (
        SELECT {K}, i, g, max({x}) FILTER ({x} <= g) AS lx, {last} FILTER ({x} <= g) AS ly,
          min({x}) FILTER ({x} > g) AS rx, {first} FILTER ({x} > g) AS ry FROM {src}, gr GROUP BY ALL))"""


@query(
    "mean_roc",
    with_views(
        "pred",
        f"SELECT {M}, i AS grid_index, g AS grid, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS sd, count(v) AS n_folds FROM pin GROUP BY ALL",
        CURVE
        + ", rc AS (SELECT *, fp / nn AS x, tp / np AS y FROM cv), "
        + interp_sql("rc", "x", "y", "arg_max(y, (x, y))", "arg_min(y, (x, y))")
        + ", pin AS (SELECT * REPLACE (CASE WHEN i = 0 THEN 0.0 WHEN i = 20 THEN 1.0 ELSE v END AS v) FROM ip)",
    ),
)
def mean_roc(spark, folder):
    return _rounded(m.mean_roc(predictions(spark, folder), 21), ["mean", "sd"])


@query(
    "mean_pr",
    with_views(
        "pred",
        f"SELECT {M}, i AS grid_index, g AS grid, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS sd, count(v) AS n_folds FROM ip GROUP BY ALL",
        CURVE
        + f""", rc AS (SELECT {K}, tp / np AS x, tp / (tp + fp) AS y FROM cv
            UNION ALL SELECT DISTINCT {K}, 0.0::DOUBLE, 1.0::DOUBLE FROM cv), """
        + interp_sql("rc", "x", "y", "arg_max(y, (x, -y))", "arg_min(y, (x, -y))"),
    ),
)
def mean_pr(spark, folder):
    return _rounded(m.mean_pr(predictions(spark, folder), 21), ["mean", "sd"])


BACC = f"""ths AS (SELECT CAST(r AS INTEGER) AS t_index, r / 100.0::DOUBLE AS threshold FROM range(101) t(r)),
  bc AS (SELECT {K}, t_index, threshold, (count(*) FILTER (y = 1 AND p >= threshold)::DOUBLE / count(*) FILTER (y = 1)
    + count(*) FILTER (y = 0 AND p < threshold)::DOUBLE / count(*) FILTER (y = 0)) / 2 AS bacc FROM pred, ths GROUP BY ALL),
  be AS (SELECT * FROM bc QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY round(bacc, 12) DESC, t_index) = 1)"""


@query("bacc_curve", with_views("pred", f"SELECT {K}, t_index, threshold, {R('bacc')} AS bacc FROM bc", BACC))
def bacc_curve(spark, folder):
    return _rounded(m.bacc_curve(predictions(spark, folder)), ["bacc"])


FOLDS = "model, variant, trial, outer_fold"


@query(
    "bacc_train_threshold",
    with_views(
        "pred",
        f"""SELECT {K}, t_index, threshold, {R('bacc')} AS bacc FROM bc JOIN (SELECT {FOLDS}, t_index FROM be WHERE split = 'train')
          USING ({FOLDS}, t_index)""",
        BACC,
    ),
)
def bacc_train_threshold(spark, folder):
    curve = m.bacc_curve(predictions(spark, folder))
    return _rounded(m.bacc_at_choice(curve, "train"), ["bacc"])


@query("bacc_split_best", with_views("pred", f"SELECT {K}, t_index, threshold, {R('bacc')} AS bacc FROM be", BACC))
def bacc_split_best(spark, folder):
    return _rounded(m.bacc_at_choice(m.bacc_curve(predictions(spark, folder)), "each"), ["bacc"])


@query(
    "bacc_summary",
    with_views(
        "pred",
        f"""SELECT {M}, {R('avg(bacc)')} AS bacc_mean, {R('stddev_samp(bacc)')} AS bacc_sd, {R('avg(threshold)')} AS threshold_mean,
          {R('stddev_samp(threshold)')} AS threshold_sd, count(*) AS n_folds
          FROM bc JOIN (SELECT {FOLDS}, t_index FROM be WHERE split = 'test') USING ({FOLDS}, t_index) GROUP BY {M}""",
        BACC,
    ),
)
def bacc_summary(spark, folder):
    d = m.bacc_summary(m.bacc_at_choice(m.bacc_curve(predictions(spark, folder)), "test"))
    return _rounded(d, ["bacc_mean", "bacc_sd", "threshold_mean", "threshold_sd"])


@query(
    "patient_auroc_auprc",
    with_views(
        "pred",
        f"SELECT {M}, n, n_pos, {R('auroc')} AS auroc, {R('auprc')} AS auprc FROM au JOIN ap USING ({M})",
        patients_sql() + ", pq AS (SELECT * REPLACE (round(p_median, 9) AS p_median) FROM pr), " + rank_sql("pq", M, "p_median"),
    ),
)
def patient_auroc_auprc(spark, folder):
    p = median_patients(spark, folder).withColumn("p_median", F.round("p_median", 9))
    return _rounded(m.patient_metrics(p, "p_median"), ["auroc", "auprc"])

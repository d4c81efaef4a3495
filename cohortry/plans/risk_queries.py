"""Patient risk, ranked patients and pockets over the long predictions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import risk
from cohortry.plans.registry import query
from cohortry.plans.views import V, with_views

KEYS = "model, variant, split, group_id"


def patients_sql(agg: str = "median", grouping: str = "all_trials") -> str:
    """CTE ``pr``: patient_risk with default parameters."""
    keys = KEYS if grouping == "all_trials" else "model, variant, split, trial, outer_fold, group_id"
    center = {
        "mean": "avg(c) AS p_mean",
        "median": "quantile_cont(c, 0.5) AS p_median",
        "max": "max(c) AS p_max",
        "quantile": "quantile_cont(c, 0.75) AS p_q75",
        "softmax": "sum(w * c) / sum(w) AS p_softmax",
    }[agg]
    lg = "5.0::DOUBLE * (ln(least(greatest(c, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(c, 1e-6), 1 - 1e-6)))"
    part = keys
    return f"""pc AS (SELECT {keys}, quantile_cont(p, 0.05) AS p_cap_low, quantile_cont(p, 0.95) AS p_cap_high,
        arg_min(subject_id, (trial, outer_fold, idx)) AS subject_id,
        arg_min(group_label, (trial, outer_fold, idx)) AS group_label, arg_min(y, (trial, outer_fold, idx)) AS y
        FROM pred GROUP BY ALL),
      pl AS (SELECT pred.* EXCLUDE (subject_id, group_label, y), p_cap_low, p_cap_high, pc.subject_id, pc.group_label, pc.y,
        least(greatest(p, p_cap_low), p_cap_high) AS c FROM pred JOIN pc USING ({keys})),
      pw AS (SELECT *, exp({lg} - max({lg}) OVER (PARTITION BY {part})) AS w FROM pl),
      pr AS (SELECT {keys}, subject_id, group_label, y, CAST(count(*) AS INTEGER) AS n_windows, {center},
        stddev_pop(c) AS p_total_std, min(p_cap_low) AS p_cap_low, min(p_cap_high) AS p_cap_high,
        '{grouping}' AS grouping, 'group_id' AS unit_col, 0.05::DOUBLE AS lower_q, 0.95::DOUBLE AS upper_q
        FROM pw GROUP BY {keys}, subject_id, group_label, y)"""


def _register_patient_risk(name: str, agg: str, grouping: str, col: str) -> None:
    keys = "model, variant, split, " + ("trial, outer_fold, " if grouping == "per_trial_fold" else "") + "group_id"
    sql = with_views(
        "pred",
        f"""SELECT {keys}, subject_id, group_label, y, n_windows, round({col} + 1e-10, 6) + 0.0 AS {col},
            round(p_total_std + 1e-10, 5) + 0.0 AS p_total_std, round(p_cap_low + 1e-10, 6) AS p_cap_low, round(p_cap_high + 1e-10, 6) AS p_cap_high,
            grouping, unit_col, lower_q, upper_q FROM pr""",
        patients_sql(agg, grouping),
    )

    @query(name, sql)
    def run(spark, folder):
        d = risk.patient_risk(V(spark, folder).predictions("group_id"), agg=agg, grouping=grouping)
        return d.withColumns(
            {
                col: r6(F.col(col)),
                "p_total_std": r6(F.col("p_total_std"), 5),
                "p_cap_low": r6(F.col("p_cap_low")),
                "p_cap_high": r6(F.col("p_cap_high")),
            }
        )


for _agg, _col in [("mean", "p_mean"), ("median", "p_median"), ("max", "p_max"), ("quantile", "p_q75"), ("softmax", "p_softmax")]:
    _register_patient_risk(f"patient_risk_{_agg}", _agg, "all_trials", _col)
_register_patient_risk("patient_risk_per_fold", "mean", "per_trial_fold", "p_mean")


def median_patients(spark, folder):
    return risk.patient_risk(V(spark, folder).predictions("group_id"), agg="median")


@query(
    "long_predictions",
    with_views("pred", "SELECT * FROM pred"),
)
def long_predictions(spark, folder):
    v = V(spark, folder)
    folds = v.predictions().where("variant = 'uncalib'").withColumn(
        "p_platt", F.round(F.lit(0.05) + F.lit(0.9) * F.col("p"), 4)
    )
    customers = v.table("customer").select(
        F.col("c_custkey").alias("group_id"),
        F.col("c_mktsegment").alias("group_label"),
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("subject_id"),
    )
    return risk.long_predictions(folds, {"uncalib": "p", "platt": "p_platt"}, customers)


@query(
    "risk_by_row",
    with_views(
        "pred",
        """SELECT model, variant, idx, arg_min(y, (trial, outer_fold)) AS y, count(p) AS n_preds, round(avg(p) + 1e-10, 6) AS p_mean,
          round(median(p) + 1e-10, 6) AS p_median, round(stddev_samp(p) + 1e-10, 6) + 0.0 AS p_std, min(p) AS p_min, max(p) AS p_max
          FROM pred WHERE split = 'test' GROUP BY ALL""",
    ),
)
def risk_by_row(spark, folder):
    d = risk.row_risk(V(spark, folder).predictions("idx").where("split = 'test'"))
    return d.withColumns({c: r6(F.col(c)) for c in ("p_mean", "p_median", "p_std")})


@query(
    "risk_by_outcome",
    with_views(
        "pred",
        """SELECT variant, count(DISTINCT CASE WHEN y = 0 THEN idx END) AS n_neg,
          count(DISTINCT CASE WHEN y = 1 THEN idx END) AS n_pos,
          round(count(DISTINCT CASE WHEN y = 1 THEN idx END)::DOUBLE / count(DISTINCT idx) + 1e-10, 6) AS prevalence
          FROM pred WHERE split = 'test' GROUP BY ALL""",
    ),
)
def risk_class_counts(spark, folder):
    d = risk.class_counts(V(spark, folder).predictions().where("split = 'test'"), ["variant"], "idx")
    return d.withColumn("prevalence", r6(F.col("prevalence")))


@query(
    "patient_risk_by_outcome",
    with_views(
        "pred",
        """SELECT model, variant, y, count(*) AS n, round(min(p_median) + 1e-10, 6) AS p_min, round(quantile_cont(p_median, 0.25) + 1e-10, 6) AS q25,
          round(quantile_cont(p_median, 0.5) + 1e-10, 6) AS q50, round(quantile_cont(p_median, 0.75) + 1e-10, 6) AS q75,
          round(max(p_median) + 1e-10, 6) AS p_max FROM pr WHERE split = 'test' GROUP BY ALL""",
        patients_sql(),
    ),
)
def patient_risk_by_outcome(spark, folder):
    d = risk.risk_by_outcome(median_patients(spark, folder).where("split = 'test'"), "p_median", ["model", "variant"])
    return d.withColumns({c: r6(F.col(c)) for c in ("p_min", "q25", "q50", "q75", "p_max")})


@query(
    "ranked_patients",
    with_views(
        "pred",
        """SELECT model, variant, group_label, group_id, rank_index, round(p_median + 1e-10, 6) AS p_median,
          round(CASE WHEN n <= 1 THEN 0 ELSE 100.0::DOUBLE * rank_index / (n - 1) END + 1e-10, 6) AS x,
          round(least(greatest(p_median - p_total_std, 0), 1) + 1e-10, 5) + 0.0 AS band_low,
          round(least(greatest(p_median + p_total_std, 0), 1) + 1e-10, 5) + 0.0 AS band_high
          FROM (SELECT *, row_number() OVER (PARTITION BY model, variant, group_label ORDER BY round(p_median, 9) DESC, group_id) - 1
            AS rank_index, count(*) OVER (PARTITION BY model, variant, group_label) AS n FROM pr WHERE split = 'test')""",
        patients_sql(),
    ),
)
def ranked_patients(spark, folder):
    p = median_patients(spark, folder).where("split = 'test'").withColumn("p_median", F.round("p_median", 9))
    d = risk.ranked_patients(p, "p_median", x_mode="percentile")
    return d.select(
        "model", "variant", "group_label", "group_id", "rank_index",
        r6(F.col("p_median")).alias("p_median"), r6(F.col("x")).alias("x"),
        r6(F.col("band_low"), 5).alias("band_low"), r6(F.col("band_high"), 5).alias("band_high"),
    )


BAND = (0.4, 0.7)


@query(
    "threshold_pocket",
    with_views(
        "pred",
        """SELECT model, variant, split, grouping, unit_col, subject_id, group_label, y, round(p_median + 1e-10, 6) AS p_median,
          n_windows, round(p_total_std + 1e-10, 5) + 0.0 AS p_total_std, lower_q, upper_q FROM pr
          WHERE split = 'test' AND subject_id NOT IN ('S1', 'S2') AND round(p_median, 9) >= 0.4 AND round(p_median, 9) < 0.7""",
        patients_sql(),
    ),
)
def threshold_pocket(spark, folder):
    d = risk.threshold_pocket(median_patients(spark, folder), BAND, drop_subjects=["S1", "S2"])
    return d.withColumns({"p_median": r6(F.col("p_median")), "p_total_std": r6(F.col("p_total_std"), 5)})


@query(
    "dedupe_subject",
    with_views(
        "pred",
        """SELECT model, variant, split, grouping, unit_col, subject_id, trial, outer_fold, n_windows, round(p_mean + 1e-10, 6) AS p_mean
          FROM (SELECT *, row_number() OVER (PARTITION BY model, variant, split, subject_id
            ORDER BY n_windows DESC, round(p_mean, 9) DESC, trial, outer_fold) AS rn FROM pr) WHERE rn = 1""",
        patients_sql("mean", "per_trial_fold"),
    ),
)
def dedupe_subject(spark, folder):
    p = risk.patient_risk(V(spark, folder).predictions("group_id"), grouping="per_trial_fold").withColumn("p_mean", F.round("p_mean", 9))
    d = risk.dedupe_subject(p, "p_mean")
    return d.select(*risk.CONTEXT, "subject_id", "trial", "outer_fold", "n_windows", r6(F.col("p_mean")).alias("p_mean"))


def pocket_sql(keys: str, sel: str, low: float, high: float) -> str:
    base = "round(p_median, 9) >= 0 AND round(p_median, 9) < 1"
    k = f"{keys}, " if keys else ""
    return with_views(
        "pred",
        f"""SELECT {k}n_selected, n_pos_selected, n_neg_selected, n_total,
          round(n_pos_selected::DOUBLE / nullif(n_selected, 0) + 1e-10, 6) AS ppv, round(n_neg_selected::DOUBLE / nullif(n_selected, 0) + 1e-10, 6) AS fdr,
          CASE WHEN n_selected = 0 THEN NULL WHEN n_neg_selected = 0 THEN 'inf'::DOUBLE
            ELSE round(n_pos_selected::DOUBLE / n_neg_selected + 1e-10, 6) END AS pos_to_neg_ratio,
          round(pos_all::DOUBLE / n_total + 1e-10, 6) AS baseline_prevalence, round(n_selected::DOUBLE / n_total + 1e-10, 6) AS pct_selected,
          CASE WHEN n_selected = 0 THEN NULL WHEN pos_all = 0 THEN 'inf'::DOUBLE
            ELSE round((n_pos_selected::DOUBLE / n_selected) / (pos_all::DOUBLE / n_total) + 1e-10, 6) END AS enrichment_factor,
          pos_label, neg_label, 'p_median' AS score_col, {low}::DOUBLE AS thr_low, {high}::DOUBLE AS thr_high
          FROM (SELECT {k}count(*) FILTER ({sel}) AS n_selected, count(*) FILTER ({sel} AND y = 1) AS n_pos_selected,
            count(*) FILTER ({sel} AND y = 0) AS n_neg_selected, count(*) FILTER ({base}) AS n_total,
            count(*) FILTER ({base} AND y = 1) AS pos_all FROM pr WHERE split = 'test' GROUP BY ALL) a
          LEFT JOIN (SELECT {k}max(group_label) FILTER (y = 1 AND rn = 1) AS pos_label,
            max(group_label) FILTER (y = 0 AND rn = 1) AS neg_label FROM (SELECT {k}y, group_label, row_number() OVER
              (PARTITION BY {k}y ORDER BY count(*) DESC, group_label) AS rn FROM pr WHERE split = 'test' AND {base}
              GROUP BY {k}y, group_label) GROUP BY ALL) b USING ({keys})""",
        patients_sql(),
    )


def _round_pocket(d):
    names = ("ppv", "fdr", "pos_to_neg_ratio", "baseline_prevalence", "pct_selected", "enrichment_factor")
    inf = float("inf")
    return d.withColumns({c: F.when(F.col(c) == inf, inf).otherwise(r6(F.col(c))) for c in names})


@query("pocket_by_model", pocket_sql("model, variant, split", "round(p_median, 9) >= 0.6", 0.6, 1.0))
def pocket_by_model(spark, folder):
    return _round_pocket(risk.pocket_by_model(median_patients(spark, folder), 0.6))


@query("pocket_from_raw", pocket_sql("variant, split", "round(p_median, 9) >= 0.4 AND round(p_median, 9) < 0.7", 0.4, 0.7))
def pocket_from_raw(spark, folder):
    return _round_pocket(risk.pocket_from_raw(median_patients(spark, folder), BAND))


@query("pocket_summary", pocket_sql("model, variant, split", "round(p_median, 9) >= 0.97", 0.97, 1.0))
def pocket_summary(spark, folder):
    return _round_pocket(risk.pocket_by_model(median_patients(spark, folder), 0.97))


METRIC_COLS = "n_selected, n_pos_selected, n_neg_selected, ppv, fdr, pos_to_neg_ratio, baseline_prevalence, enrichment_factor"


@query(
    "pocket_metrics",
    f"SELECT model, variant, {METRIC_COLS} FROM ({pocket_sql('model, variant, split', 'round(p_median, 9) >= 0.5', 0.5, 1.0)})",
)
def pocket_metrics(spark, folder):
    people = risk.population(median_patients(spark, folder), "p_median")
    p = F.col("p_median")
    d = risk.pocket_metrics(people, risk.in_threshold(p, 0.5), risk.in_threshold(p, (0.0, 1.0)), ["model", "variant"])
    return _round_pocket(d).select("model", "variant", *METRIC_COLS.split(", "))


@query(
    "pocket_label_counts",
    with_views(
        "pred",
        """SELECT model, variant, split, group_label, count(*) AS n_selected FROM pr
          WHERE split = 'test' AND round(p_median, 9) >= 0.4 AND round(p_median, 9) < 0.7 GROUP BY ALL""",
        patients_sql(),
    ),
)
def pocket_label_counts(spark, folder):
    return risk.pocket_label_counts(median_patients(spark, folder), BAND)

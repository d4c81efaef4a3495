"""Long prediction tables, patient-level risk and enrichment of score pockets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import array_quantile, clip, logit, ratio_or_inf
from cohortry.functions.ordering import (
    BUCKET,
    by_group_size,
    grouped_quantiles,
    row_index,
    run_quantile,
    value_runs,
    with_range_bucket,
)
from cohortry.functions.rows import keep_first

SCHEMES = {
    "all_trials": ["model", "variant", "split"],
    "per_trial_fold": ["model", "variant", "split", "trial", "outer_fold"],
}


def long_predictions(folds: DataFrame, variants: Mapping[str, str], groups: DataFrame | None = None) -> DataFrame:
    """Unpivot one probability column per variant and attach the group dimension.

    ``folds`` has model, split, trial, outer_fold, idx, group_id, y and the columns
    named in ``variants`` (variant name -> column); ``groups`` has group_id,
    group_label, subject_id.
    """
    keys = ["model", "split", "trial", "outer_fold", "idx", "group_id", "y"]
    picked = folds.select(*keys, *[F.col(c).cast("double").alias(v) for v, c in variants.items()])
    out = picked.unpivot(keys, list(variants), "variant", "p").where(F.col("p").isNotNull())
    if groups is not None:
        out = out.join(groups.select("group_id", "group_label", "subject_id"), "group_id", "left")
    cols = ["model", "variant", *keys[1:6], "group_label", "subject_id", "y", "p"]
    return out.select(*[c for c in cols if c in out.columns])


def patient_risk(
    predictions: DataFrame,
    agg: str = "mean",
    quantile: float = 0.75,
    beta: float = 5.0,
    eps: float = 1e-6,
    lower_q: float = 0.05,
    upper_q: float = 0.95,
    ddof: int = 0,
    grouping: str = "all_trials",
    unit: str | None = None,
    splits: Sequence[str] | None = None,
) -> DataFrame:
    """One row per unit: its scores clipped to their own quantiles, then pooled."""
    if unit is None:
        unit = next(c for c in ("group_id", "subject_id", "idx") if c in predictions.columns)
    keys = SCHEMES[grouping] + [unit]
    d = predictions if splits is None else predictions.where(F.col("split").isin(list(splits)))
    d = d.where(F.col("p").isNotNull())
    first = F.struct(*[F.col(c) for c in ("trial", "outer_fold", "idx") if c in d.columns])
    attrs = [c for c in ("subject_id", "group_label", "y") if c in d.columns and c not in keys]
    head = F.min_by(F.struct(*attrs), first).alias("__head")
    pool = _Pool(keys, agg, quantile, beta, eps, lower_q, upper_q, ddof)
    out = by_group_size(d, keys, lambda x: pool.small(x, head), lambda x: pool.large(x, head), many=True)
    return out.select(
        *keys,
        *[F.col("__head")[c].alias(c) for c in attrs],
        "n_windows",
        pool.name,
        "p_total_std",
        "p_cap_low",
        "p_cap_high",
        F.lit(grouping).alias("grouping"),
        F.lit(unit).alias("unit_col"),
        F.lit(float(lower_q)).alias("lower_q"),
        F.lit(float(upper_q)).alias("upper_q"),
    )


class _Pool:
    """Pooling of one unit's scores, as a sorted array or as value runs."""

    def __init__(self, keys, agg, quantile, beta, eps, lower_q, upper_q, ddof):
        names = {"mean": "p_mean", "median": "p_median", "max": "p_max", "softmax": "p_softmax"}
        names["quantile"] = f"p_q{round(quantile * 100)}"
        if agg not in names:
            raise ValueError(f"unknown aggregation {agg!r}")
        self.keys, self.agg, self.name = keys, agg, names[agg]
        self.quantile = 0.5 if agg == "median" else quantile
        self.beta, self.eps, self.ddof = beta, eps, ddof
        self.lower_q, self.upper_q = lower_q, upper_q

    def small(self, d: DataFrame, head: Column) -> DataFrame:
        """One shuffle: the sorted scores of a unit and array arithmetic on them."""
        d = d.groupBy(*self.keys).agg(head, F.sort_array(F.collect_list("p")).alias("__p"))
        none = F.lit(None).cast("double")
        low = array_quantile(F.col("__p"), self.lower_q) if self.lower_q > 0 else none
        high = array_quantile(F.col("__p"), self.upper_q) if self.upper_q < 1 else none
        d = d.withColumns({"p_cap_low": low, "p_cap_high": high, "n_windows": F.size("__p")})
        used = F.transform("__p", lambda x: clip(x, F.col("p_cap_low"), F.col("p_cap_high")))
        d = d.withColumn("__c", used)
        total = lambda f: F.aggregate("__c", F.lit(0.0), lambda a, x: a + f(x))
        d = d.withColumn("__mean", total(lambda x: x) / F.col("n_windows"))
        spread = total(lambda x: (x - F.col("__mean")) * (x - F.col("__mean")))
        if self.agg == "mean":
            center = F.col("__mean")
        elif self.agg == "max":
            center = F.array_max("__c")
        elif self.agg == "softmax":
            score = lambda x: self.beta * logit(x, self.eps)
            d = d.withColumn("__top", F.greatest(score(F.array_max("__c")), score(F.array_min("__c"))))
            weight = lambda x: F.exp(score(x) - F.col("__top"))
            center = total(lambda x: weight(x) * x) / total(weight)
        else:
            center = array_quantile(F.col("__c"), self.quantile)
        return d.select(
            *self.keys,
            "__head",
            "n_windows",
            center.alias(self.name),
            F.sqrt(F.try_divide(spread, F.col("n_windows") - self.ddof)).alias("p_total_std"),
            "p_cap_low",
            "p_cap_high",
        )

    def large(self, d: DataFrame, head: Column) -> DataFrame:
        """The same from (unit, distinct score, count) runs cut into score ranges."""
        keys = self.keys
        runs = value_runs(d.select(*keys, "p"), keys, "p").persist()
        none = F.lit(None).cast("double")
        low = run_quantile("p", self.lower_q) if self.lower_q > 0 else none
        high = run_quantile("p", self.upper_q) if self.upper_q < 1 else none
        ends = [F.min("p").alias("p_min"), F.max("p").alias("p_max")]
        caps = runs.groupBy(*keys).agg(low.alias("p_cap_low"), high.alias("p_cap_high"), *ends)
        cells = runs.select(*keys, BUCKET).distinct().join(caps, keys)
        bounds = (F.col("p_cap_low"), F.col("p_cap_high"))
        c = runs.join(cells, [*keys, BUCKET]).withColumn("c", clip(F.col("p"), *bounds))
        means = c.groupBy(*keys).agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("__mean"))
        n = F.sum("n")
        if self.agg == "mean":
            center = F.max("__mean")
        elif self.agg == "max":
            center = F.max("c")
        elif self.agg == "softmax":
            top = F.greatest(*[self.beta * logit(clip(F.col(e), *bounds), self.eps) for e in ("p_min", "p_max")])
            w = F.col("n") * F.exp(self.beta * logit(F.col("c"), self.eps) - top)
            center = F.sum(w * F.col("c")) / F.sum(w)
        else:
            center = run_quantile("c", self.quantile)
        # squares around the mean, as for small units
        off = F.col("c") - F.col("__mean")
        spread = F.sqrt(F.try_divide(F.sum(F.col("n") * off * off), n - self.ddof))
        spots = c.select(*keys, BUCKET).distinct().join(means, keys)
        out = c.join(spots, [*keys, BUCKET]).groupBy(*keys).agg(
            n.cast("int").alias("n_windows"),
            center.alias(self.name),
            spread.alias("p_total_std"),
            F.max("p_cap_low").alias("p_cap_low"),
            F.max("p_cap_high").alias("p_cap_high"),
        )
        return out.join(d.groupBy(*keys).agg(head), keys)


def row_risk(predictions: DataFrame) -> DataFrame:
    """Per (model, variant, row): label, number of scores and their spread.

    A row is scored once per trial, so these groups are small by construction.
    """
    return predictions.groupBy("model", "variant", "idx").agg(
        F.min_by("y", F.struct("trial", "outer_fold")).alias("y"),
        F.count("p").alias("n_preds"),
        F.avg("p").alias("p_mean"),
        F.median("p").alias("p_median"),
        F.stddev_samp("p").alias("p_std"),
        F.min("p").alias("p_min"),
        F.max("p").alias("p_max"),
    )


def class_counts(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Unique units per class and prevalence of the positive class."""
    units = df.groupBy(*keys, unit).agg(F.min("y").alias("y"))
    return units.groupBy(*keys).agg(
        F.count_if(F.col("y") == 0).alias("n_neg"),
        F.count_if(F.col("y") == 1).alias("n_pos"),
        F.avg(F.col("y").cast("double")).alias("prevalence"),
    )


def risk_by_outcome(patients: DataFrame, score: str, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Five-number summary of the patient score per outcome."""
    keys = [*keys, "y"]
    qs = {"p_min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p_max": 1.0}
    return grouped_quantiles(patients, keys, score, qs)


def ranked_patients(
    patients: DataFrame,
    score: str,
    keys: Sequence[str] = ("model", "variant", "group_label"),
    unit: str = "group_id",
    x_mode: str = "index",
    clip_to: tuple[float, float] = (0.0, 1.0),
) -> DataFrame:
    """Patients by descending score with index or 0-100 percentile and +-sd band."""
    order = [F.col(score).desc(), F.col(unit)]
    keys = list(keys)
    d = patients.where(F.col(score).isNotNull()).persist()  # measured, cut and read
    bucket = lambda x: with_range_bucket(x, score, descending=True)
    out = row_index(d, keys, order, bucket, "rank_index", total="n_ranked")
    if x_mode == "percentile":
        x = F.when(F.col("n_ranked") <= 1, 0.0).otherwise(100.0 * F.col("rank_index") / (F.col("n_ranked") - 1))
    elif x_mode == "index":
        x = F.col("rank_index").cast("double")
    else:
        raise ValueError(f"unknown x_mode {x_mode!r}")
    low = clip(F.col(score) - F.col("p_total_std"), *clip_to)
    high = clip(F.col(score) + F.col("p_total_std"), *clip_to)
    return out.withColumns({"x": x, "band_low": low, "band_high": high}).drop("n_ranked")


# ------------------------------------------------------------------ pockets

Threshold = float | tuple[float, float]
CONTEXT = ["model", "variant", "split", "grouping", "unit_col"]


#: Digits of a score that count at the edges of a pocket.
DIGITS = 9


def in_threshold(score: Column, threshold: Threshold) -> Column:
    """score >= t, or the half-open band low <= score < high.

    Scores are compared at ``DIGITS`` digits: the last bit of an interpolated quantile does
    not decide on which side of an edge a unit lies.
    """
    score = F.round(score, DIGITS)
    if isinstance(threshold, tuple):
        low, high = threshold
        if low > high:
            raise ValueError(f"band is empty: {threshold}")
        return (score >= low) & (score < high)
    return score >= float(threshold)


def dedupe_subject(patients: DataFrame, score: str, keys: Sequence[str] = CONTEXT, subject: str = "subject_id") -> DataFrame:
    """One row per subject and context: most windows, then highest score."""
    order = [-F.col(c) for c in ("n_windows", score) if c in patients.columns]
    ties = [F.col(c) for c in ("trial", "outer_fold", "group_id") if c in patients.columns]
    return keep_first(patients, [*keys, subject], order + ties)


def population(
    patients: DataFrame,
    score: str,
    split: str | None = "test",
    models: Sequence[str] | None = None,
    variants: Sequence[str] | None = None,
    drop_subjects: Sequence[str] | None = None,
    enforce_unique: bool = True,
    keys: Sequence[str] = CONTEXT,
    subject: str = "subject_id",
) -> DataFrame:
    """Rows a pocket is chosen from: exclusions, filters, scored rows, one per subject."""
    d = patients.where(F.col(score).isNotNull())
    if drop_subjects:
        d = d.where(~F.col(subject).isin(list(drop_subjects)))
    if split is not None:
        d = d.where(F.col("split") == split)
    if models is not None:
        d = d.where(F.col("model").isin(list(models)))
    if variants is not None:
        d = d.where(F.col("variant").isin(list(variants)))
    return dedupe_subject(d, score, keys, subject) if enforce_unique else d


def threshold_pocket(patients: DataFrame, threshold: Threshold, score: str = "p_median", **filters) -> DataFrame:
    """The pocket itself, with the default columns."""
    keys = list(filters.get("keys", CONTEXT))
    subject = filters.get("subject", "subject_id")
    d = population(patients, score, **filters).where(in_threshold(F.col(score), threshold))
    extra = [c for c in ("n_windows", "p_total_std", "lower_q", "upper_q") if c in d.columns]
    return d.select(*keys, subject, "group_label", "y", score, *extra)


def pocket_metrics(
    people: DataFrame, selected: Column, baseline: Column, keys: Sequence[str] = (), y: str = "y"
) -> DataFrame:
    """Purity, contamination and enrichment of ``selected`` against ``baseline``.

    One pass of conditional sums; a key whose pocket is empty keeps its row with
    null rates.
    """
    pos, neg = F.col(y) == 1, F.col(y) == 0
    sums = people.groupBy(*keys).agg(
        F.count_if(selected & F.col(y).isNotNull()).alias("n_selected"),
        F.count_if(selected & pos).alias("n_pos_selected"),
        F.count_if(selected & neg).alias("n_neg_selected"),
        F.count_if(baseline & F.col(y).isNotNull()).alias("n_total"),
        F.count_if(baseline & pos).alias("__pos_all"),
    )
    some = F.col("n_selected") > 0
    share = lambda c: F.when(some, F.try_divide(F.col(c).cast("double"), F.col("n_selected").cast("double")))
    base = F.try_divide(F.col("__pos_all").cast("double"), F.col("n_total").cast("double"))
    out = sums.withColumns(
        {
            "ppv": share("n_pos_selected"),
            "fdr": share("n_neg_selected"),
            "pos_to_neg_ratio": F.when(some, ratio_or_inf(F.col("n_pos_selected"), F.col("n_neg_selected"))),
            "baseline_prevalence": base,
            "pct_selected": F.try_divide(F.col("n_selected").cast("double"), F.col("n_total").cast("double")),
        }
    )
    enrichment = F.when(some, ratio_or_inf(F.col("ppv"), F.coalesce(F.col("baseline_prevalence"), F.lit(0.0))))
    return out.withColumn("enrichment_factor", enrichment).drop("__pos_all")


def label_names(people: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Most common label of each class (ties: smallest label)."""
    pick = lambda v: F.mode(F.when(F.col("y") == v, F.col("group_label")), True)
    names = people.groupBy(*keys).agg(pick(1).alias("pos_label"), pick(0).alias("neg_label"))
    return names.withColumns(
        {"pos_label": F.coalesce("pos_label", F.lit("pos")), "neg_label": F.coalesce("neg_label", F.lit("neg"))}
    )


def pocket_from_raw(
    patients: DataFrame,
    threshold: Threshold,
    score: str = "p_median",
    keys: Sequence[str] = ("variant", "split"),
    **filters,
) -> DataFrame:
    """Pocket summary per ``keys``; the baseline is the band [0, 1), so p = 1 is outside it."""
    people = population(patients, score, **filters)
    selected = in_threshold(F.col(score), threshold)
    baseline = in_threshold(F.col(score), (0.0, 1.0))
    m = pocket_metrics(people, selected, baseline, keys)
    names = label_names(people.where(baseline), keys)
    low, high = threshold if isinstance(threshold, tuple) else (float(threshold), 1.0)
    if keys:
        out = m.join(names, list(keys), "left")
    else:
        both = names.first()
        out = m.withColumns({c: F.lit(both[c]) for c in ("pos_label", "neg_label")})
    return out.withColumns({"score_col": F.lit(score), "thr_low": F.lit(float(low)), "thr_high": F.lit(float(high))})


def pocket_by_model(patients: DataFrame, threshold: Threshold, score: str = "p_median", **filters) -> DataFrame:
    """The same summary for every model at once: the model is a grouping key, not a loop."""
    return pocket_from_raw(patients, threshold, score, ("model", "variant", "split"), **filters)


def pocket_label_counts(patients: DataFrame, threshold: Threshold, score: str = "p_median", **filters) -> DataFrame:
    """Labels inside the pocket."""
    d = threshold_pocket(patients, threshold, score, **filters)
    return d.groupBy("model", "variant", "split", "group_label").agg(F.count(F.lit(1)).alias("n_selected"))



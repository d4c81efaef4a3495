"""Description, cleaning and encoding over the matrix and order views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import prep
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import FEATURES, V, with_views

COLS = ", ".join(FEATURES)
LONG = f"lg AS (SELECT row_id, feature, value FROM mxn UNPIVOT INCLUDE NULLS (value FOR feature IN ({COLS})))"
GAPS = ["price", "tax"]


def _rounded(df, names, digits=6):
    return df.withColumns({c: r6(F.col(c), digits) for c in names})


def _params(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(
    "describe_features",
    with_views(
        "mxn",
        f"""SELECT feature, count(value) AS count, {R('avg(value)', 4)} AS mean, {R('stddev_samp(value)', 4)} AS std,
          {R('min(value)', 4)} AS min, {R('quantile_cont(value, 0.05)', 4)} AS p05, {R('quantile_cont(value, 0.25)', 4)} AS p25,
          {R('quantile_cont(value, 0.5)', 4)} AS p50, {R('quantile_cont(value, 0.75)', 4)} AS p75,
          {R('quantile_cont(value, 0.95)', 4)} AS p95, {R('max(value)', 4)} AS max FROM lg GROUP BY feature""",
        LONG,
    ),
)
def describe_features(spark, folder):
    d = prep.describe_features(V(spark, folder).missing(), FEATURES)
    return _rounded(d, [c for c in d.columns if c not in ("feature", "count")], 4)


@query(
    "feature_stat_hist",
    with_views(
        "mxn",
        f"""SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n_features,
          {R('min(v)', 4)} AS min_value, {R('max(v)', 4)} AS max_value
          FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM
            (SELECT feature, avg(value) AS v FROM lg GROUP BY feature)) GROUP BY 1""",
        LONG,
    ),
)
def feature_stat_hist(spark, folder):
    d = prep.describe_features(V(spark, folder).missing(), FEATURES, percentiles=())
    return _rounded(prep.feature_stat_distribution(d, "mean"), ["min_value", "max_value"], 4)


@query(
    "missing_by_feature",
    with_views(
        "mxn",
        "SELECT feature, count(value) AS n_present, count(*) - count(value) AS n_missing FROM lg GROUP BY feature",
        LONG,
    ),
)
def missing_by_feature(spark, folder):
    return prep.missing_by_feature(V(spark, folder).missing(), FEATURES)


@query(
    "missing_patterns",
    with_views(
        "mxn",
        "SELECT "
        + " || ".join(f"CAST(CAST({c} IS NULL AS INTEGER) AS VARCHAR)" for c in FEATURES)
        + " AS pattern, count(*) AS n_rows FROM mxn GROUP BY 1",
    ),
)
def missing_patterns(spark, folder):
    return prep.missing_patterns(V(spark, folder).missing(), FEATURES)


@query(
    "value_counts_total",
    with_views(
        "cat",
        f"""SELECT value, n, {R('100.0::DOUBLE * n / (SELECT count(*) FROM cat)')} AS percent FROM (
          SELECT coalesce(priority, 'Missing') AS value, count(*) AS n FROM cat GROUP BY 1
          UNION ALL SELECT 'Total', count(*) FROM cat)""",
    ),
)
def value_counts_total(spark, folder):
    return _rounded(prep.value_counts(V(spark, folder).categorical(), "priority"), ["percent"])


@query(
    "winsor_caps",
    with_views(
        "mxn",
        f"""SELECT feature, {R('quantile_cont(value, 0.05)')} AS lower, {R('quantile_cont(value, 0.95)')} AS upper
          FROM lg GROUP BY feature""",
        LONG,
    ),
)
def winsor_caps(spark, folder):
    caps = prep.winsor_caps(V(spark, folder).missing(), FEATURES)
    rows = [(c, lo, hi) for c, (lo, hi) in caps.items()]
    return _rounded(_params(spark, rows, "feature string, lower double, upper double"), ["lower", "upper"])


CLIP = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.05) FROM mxn)),"
    f" (SELECT quantile_cont({c}, 0.95) FROM mxn)) END AS {c}"
    for c in FEATURES
)
ROUND4 = ", ".join(f"{R(c, 4)} AS {c}" for c in FEATURES)


@query("winsorize", with_views("mxn", f"SELECT row_id, {ROUND4} FROM (SELECT row_id, {CLIP} FROM mxn)"))
def winsorize(spark, folder):
    d = V(spark, folder).missing()
    out = prep.winsorize(d, prep.winsor_caps(d, FEATURES))
    return _rounded(out.select("row_id", *FEATURES), FEATURES, 4)


def _impute_query(name, strategy, fill):
    sel = ", ".join(f"{R(f'coalesce({c}, {fill(c)})', 4)} AS {c}" for c in GAPS)

    @query(name, with_views("mxn", f"SELECT row_id, {sel} FROM mxn"))
    def run(spark, folder):
        d = V(spark, folder).missing()
        out = prep.impute(d, prep.fit_fill(d, GAPS, strategy, constant=-1.0))
        return _rounded(out.select("row_id", *GAPS), GAPS, 4)


_impute_query("impute_mean", "mean", lambda c: f"(SELECT avg({c}) FROM mxn)")
_impute_query("impute_median", "median", lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM mxn)")
_impute_query("impute_constant", "constant", lambda c: "-1.0::DOUBLE")
_impute_query(
    "impute_mode",
    "most_frequent",
    lambda c: f"(SELECT {c} FROM mxn WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)",
)

SCALE = ", ".join(
    f"{R(f'({c} - (SELECT avg({c}) FROM mxn)) / (SELECT stddev_pop({c}) FROM mxn)')} AS {c}" for c in FEATURES
)


@query("standardize", with_views("mxn", f"SELECT row_id, {SCALE} FROM mxn"))
def standardize(spark, folder):
    d = V(spark, folder).missing()
    out = prep.standardize(d, prep.fit_scale(d, FEATURES))
    return _rounded(out.select("row_id", *FEATURES), FEATURES)


FILLED = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM mxn)) AS {c}" for c in FEATURES)
PREP = f"""cl AS (SELECT row_id, {CLIP} FROM mxn), fl AS (SELECT row_id, {FILLED} FROM cl),
  ml AS (SELECT feature, value FROM fl UNPIVOT (value FOR feature IN ({COLS}))),
  pm AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS scale FROM ml GROUP BY feature)"""
PREP_Z = ", ".join(
    f"{R(f'({c} - (SELECT avg({c}) FROM fl)) / (SELECT stddev_pop({c}) FROM fl)')} AS {c}" for c in FEATURES
)


@query("preprocess_table", with_views("mxn", f"SELECT row_id, {PREP_Z} FROM fl", PREP))
def preprocess_table(spark, folder):
    d = V(spark, folder).missing()
    out = prep.PrepModel.fit(d, FEATURES).transform(d)
    return _rounded(out.select("row_id", *FEATURES), FEATURES)


@query(
    "unscale_grid",
    with_views(
        "mxn",
        f"SELECT feature, g AS value, {R('g * scale + mean', 4)} AS value_raw FROM pm, (VALUES (-1.0::DOUBLE), (0.0), (2.0)) t(g)",
        PREP,
    ),
)
def unscale_grid(spark, folder):
    d = V(spark, folder).missing()
    params = prep.PrepModel.fit(d, FEATURES).params(spark)
    grid = params.select("feature", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(2.0))).alias("value"))
    return _rounded(prep.unscale(grid, params), ["value_raw"], 4)


STRINGS = ["status", "priority", "site"]


@query(
    "cardinality_buckets",
    with_views(
        "cat",
        """SELECT feature, n_levels, CASE WHEN n_levels <= 3 THEN 'onehot' WHEN n_levels <= 10 THEN 'ordinal'
          ELSE 'dropped' END AS bucket FROM (
          SELECT 'status' AS feature, count(DISTINCT status) + max(CAST(status IS NULL AS INTEGER)) AS n_levels FROM cat
          UNION ALL SELECT 'priority', count(DISTINCT priority) + max(CAST(priority IS NULL AS INTEGER)) FROM cat
          UNION ALL SELECT 'site', count(DISTINCT site) + max(CAST(site IS NULL AS INTEGER)) FROM cat)""",
    ),
)
def cardinality_buckets(spark, folder):
    return prep.cardinality_buckets(V(spark, folder).categorical(), STRINGS)


def _levels_sql(c: str) -> str:
    return (
        f"lv_{c} AS (SELECT {c} AS level, row_number() OVER (ORDER BY min(row_id)) - 1 AS code"
        f" FROM cat WHERE {c} IS NOT NULL GROUP BY {c})"
    )


@query(
    "one_hot",
    with_views(
        "cat",
        """SELECT row_id, level, CASE WHEN status IS NOT NULL THEN CAST(status = level AS DOUBLE) END AS flag
          FROM cat, lv_status WHERE code > 0""",
        _levels_sql("status"),
    ),
)
def one_hot(spark, folder):
    d = V(spark, folder).categorical().select("row_id", "status")
    enc = prep.Encoder.fit(d, {"status": "onehot"})
    wide = enc.transform(d)
    names = [c for c in wide.columns if c != "row_id"]
    return wide.unpivot(["row_id"], names, "level", "flag").withColumn("level", F.replace("level", F.lit("status_"), F.lit("")))


@query(
    "ordinal_encode",
    with_views(
        "cat",
        "SELECT row_id, CAST(code AS DOUBLE) AS priority FROM cat LEFT JOIN lv_priority ON priority = level",
        _levels_sql("priority"),
    ),
)
def ordinal_encode(spark, folder):
    d = V(spark, folder).categorical().select("row_id", "priority")
    return prep.Encoder.fit(d, {"priority": "ordinal"}).transform(d)


KINDS = {"status": "onehot", "priority": "ordinal", "site": "dropped"}


@query(
    "encoding_meta",
    with_views(
        "cat",
        """SELECT 'status_' || level AS out_col, 'status' AS source_col, 'onehot' AS type, level FROM lv_status WHERE code > 0
          UNION ALL SELECT 'priority', 'priority', 'ordinal', NULL UNION ALL SELECT 'total', 'total', 'numeric', NULL""",
        _levels_sql("status"),
    ),
)
def encoding_meta(spark, folder):
    return prep.Encoder.fit(V(spark, folder).categorical(), KINDS).meta(spark, ["total"])


@query(
    "impute_cat_mode",
    with_views(
        "cat",
        """SELECT row_id, total, coalesce(CAST(code AS DOUBLE), (SELECT CAST(code AS DOUBLE) FROM cat JOIN lv_priority
          ON priority = level GROUP BY code ORDER BY count(*) DESC, code LIMIT 1)) AS priority
          FROM cat LEFT JOIN lv_priority ON priority = level""",
        _levels_sql("priority"),
    ),
)
def impute_cat_mode(spark, folder):
    d = V(spark, folder).categorical().select("row_id", "total", "priority")
    enc = prep.Encoder.fit(d, {"priority": "ordinal"})
    return prep.impute_categorical(enc.transform(d), enc.meta(spark, ["total"]))

"""Describe, winsorise, impute, encode and scale feature columns.

Fitting is an aggregate that leaves one small row of parameters per feature;
applying is a projection of literals, so the rows are read and written once and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.columns import clip
from cohortry.functions.ordering import BUCKET, column_quantiles, row_index, text_bucket, with_range_bucket
from cohortry.session import cut_lineage

#: Ordinal levels of a column that are written into the plan, and one-hot columns a schema may get from one column.
INLINE = 2000
WIDEST = 10_000
PARAMS = "feature string, lower double, upper double, fill double, mean double, scale double, kind string"


def unpivoted(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value) in long form."""
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), "feature", "value")


def _wide(df: DataFrame, columns: Sequence[str], aggs: Mapping[str, object]) -> dict[str, dict[str, object]]:
    """One pass of aggregates over all columns: {column: {name: value}}."""
    exprs = [fn(c).alias(f"{i}.{name}") for i, c in enumerate(columns) for name, fn in aggs.items()]
    row = df.agg(*exprs).first()
    return {c: {name: row[f"{i}.{name}"] for name in aggs} for i, c in enumerate(columns)}


# ---------------------------------------------------------------- describe


def describe_features(
    df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)
) -> DataFrame:
    """count, mean, sample sd, min, percentiles and max; one row per feature."""
    stats = _wide(df, columns, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quantiles = column_quantiles(df, columns, percentiles)
    names = [f"p{round(q * 100):02d}" for q in percentiles]
    rows = [
        (c, s["count"], s["mean"], s["std"], s["min"], *quantiles[c], s["max"])
        for c, s in ((c, stats[c]) for c in columns)
    ]
    schema = "feature string, count bigint, mean double, std double, min double, "
    schema += "".join(f"{n} double, " for n in names) + "max double"
    return df.sparkSession.createDataFrame(rows, schema)


def feature_stat_distribution(described: DataFrame, stat: str, n_bins: int = 10) -> DataFrame:
    """Histogram of one statistic over the features (one row per nonempty bin)."""
    low, high = described.agg(F.min(stat)).scalar(), described.agg(F.max(stat)).scalar()
    d = described.select(F.col(stat).alias("v"), low.alias("lo"), high.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    inner = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(n_bins - 1))
    d = d.where(F.col("v").isNotNull()).withColumn("bin", F.coalesce(inner, F.lit(0)).cast("int"))
    return d.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_features"), F.min("v").alias("min_value"), F.max("v").alias("max_value")
    )


def missing_by_feature(df: DataFrame, columns: Sequence[str], first: int | None = None) -> DataFrame:
    """Present and missing counts of the (first) columns."""
    columns = list(columns)[:first]
    counts = _wide(df, columns, {"n_present": F.count, "n_missing": lambda c: F.count_if(F.col(c).isNull())})
    rows = [(c, v["n_present"], v["n_missing"]) for c, v in counts.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, n_present bigint, n_missing bigint")


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per pattern of missing columns; 1 marks a missing value."""
    flags = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and percent per value, nulls as 'Missing', with a 'Total' row."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("Missing"))
    counts = df.select(value.alias("value")).rollup("value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(F.coalesce("value", F.lit("Total")).alias("value"), "n", (100.0 * F.col("n") / total).alias("percent"))


# --------------------------------------------------------- winsorise, impute


def winsor_caps(df: DataFrame, columns: Sequence[str], lower: float = 0.05, upper: float = 0.95) -> dict:
    """{column: (lower cap, upper cap)} from exact linear quantiles."""
    return {c: tuple(q) for c, q in column_quantiles(df, columns, [lower, upper]).items()}


def winsorize(df: DataFrame, caps: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in caps.items() if lo is not None})


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column; ties go to the smallest value."""
    counts = unpivoted(df, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
    best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))
    found = {r["feature"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def fit_fill(df: DataFrame, columns: Sequence[str], strategy: str = "median", constant=None) -> dict:
    """Fill value per column; a column without any value keeps null."""
    if strategy == "mean":
        return {c: v["mean"] for c, v in _wide(df, columns, {"mean": F.avg}).items()}
    if strategy == "median":
        return {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}
    if strategy == "most_frequent":
        return modes(df, columns)
    if strategy == "constant":
        return {c: constant for c in columns}
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population sd)}; a zero sd scales by 1."""
    stats = _wide(df, columns, {"mean": F.avg, "sd": F.stddev_pop})
    return {c: (s["mean"], s["sd"] or 1.0) for c, s in stats.items()}


def standardize(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    cols = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items() if m is not None}
    return df.withColumns(cols)


def unscale(grid: DataFrame, params: DataFrame, value: str = "value", out: str = "value_raw") -> DataFrame:
    """Back to raw units by feature name; an unknown feature is an error."""
    p = params.select("feature", F.col("mean").alias("__mean"), F.col("scale").alias("__scale"))
    joined = grid.join(p, "feature", "left")
    known = F.col("__scale").isNotNull()
    raw = F.when(known, F.col(value) * F.col("__scale") + F.col("__mean"))
    checked = F.when(~known, F.raise_error(F.concat(F.lit("no scaling for feature "), F.col("feature")))).otherwise(raw)
    return joined.select(*grid.columns, checked.cast("double").alias(out))


class PrepModel:
    """Fitted preprocessing: caps, fills and scales of continuous columns, modes of the rest."""

    def __init__(self, caps: dict, fills: dict, scales: dict, categories: dict):
        self.caps, self.fills, self.scales, self.categories = caps, fills, scales, categories

    @staticmethod
    def fit(
        df: DataFrame,
        continuous: Sequence[str],
        categorical: Sequence[str] = (),
        lower: float = 0.05,
        upper: float = 0.95,
        strategy: str = "median",
    ) -> PrepModel:
        """Caps and medians come from one selection: capping cannot move a median."""
        if strategy == "median":
            q = column_quantiles(df, continuous, [lower, 0.5, upper])
            caps = {c: (v[0], v[2]) for c, v in q.items()}
            fills = {c: v[1] for c, v in q.items()}
        else:
            caps = winsor_caps(df, continuous, lower, upper)
            fills = fit_fill(winsorize(df, caps), continuous, strategy)
        filled = impute(winsorize(df, caps), fills)
        scales = fit_scale(filled, continuous)
        return PrepModel(caps, fills, scales, modes(df, categorical) if categorical else {})

    def transform(self, df: DataFrame) -> DataFrame:
        out = impute(winsorize(df, self.caps), self.fills)
        return impute(standardize(out, self.scales), self.categories)

    def params(self, spark) -> DataFrame:
        """The fitted numbers as a table, for saving next to the data."""
        rows = [
            (c, *self.caps[c], self.fills[c], *self.scales[c], "continuous") for c in self.caps
        ] + [(c, None, None, None, None, None, "categorical") for c in self.categories]
        return spark.createDataFrame(rows, PARAMS)


# ------------------------------------------------------------------ encode


def level_table(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(feature, level, first, n): levels with the first row they appear in."""
    long = df.select(order, *[F.col(c).cast("string").alias(c) for c in columns])
    long = long.unpivot([order], list(columns), "feature", "level")
    return long.groupBy("feature", "level").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def cardinality_buckets(
    df: DataFrame,
    columns: Sequence[str],
    onehot_max: int = 3,
    ordinal_max: int = 10,
    force: Mapping[str, str] | None = None,
    rest: str = "dropped",
    order: str = "row_id",
) -> DataFrame:
    """Encoding chosen per string column; a missing value counts as one level."""
    n = level_table(df, columns, order).groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"))
    auto = (
        F.when(F.col("n_levels") <= onehot_max, "onehot").when(F.col("n_levels") <= ordinal_max, "ordinal").otherwise(rest)
    )
    forced: Column = F.lit(None).cast("string")
    for column, kind in (force or {}).items():
        forced = F.when(F.col("feature") == column, kind).otherwise(forced)
    return n.withColumn("bucket", F.coalesce(forced, auto))


class Encoder:
    """One-hot and ordinal encoding with levels in first-appearance order.

    Ordinal columns of more than ``INLINE`` levels keep them as a table (level, code) that
    is joined; any number of levels can be coded.  One-hot levels are columns, so the
    schema bounds them.
    """

    def __init__(self, kinds: dict[str, str], levels: dict[str, list[str]], tables: dict[str, DataFrame] | None = None):
        self.kinds, self.levels, self.tables = kinds, levels, tables or {}

    @staticmethod
    def fit(
        df: DataFrame,
        kinds: Mapping[str, str],
        order: str = "row_id",
        given: Mapping[str, Sequence[str]] | None = None,
    ) -> Encoder:
        """``kinds``: column -> onehot | ordinal | dropped | passthrough."""
        coded = [c for c, k in kinds.items() if k in ("onehot", "ordinal") and c not in (given or {})]
        levels: dict[str, list[str]] = {c: list(v) for c, v in (given or {}).items()}
        tables: dict[str, DataFrame] = {}
        if coded:
            found = cut_lineage(level_table(df, coded, order).where(F.col("level").isNotNull()))
            sizes = {r["feature"]: r["n"] for r in found.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
            for c in coded:
                mine = found.where(F.col("feature") == c)
                if kinds[c] == "onehot" and sizes.get(c, 0) > WIDEST:
                    raise ValueError(f"{c} has {sizes[c]} levels: more one-hot columns than the {WIDEST} a table may have")
                if kinds[c] == "onehot" or sizes.get(c, 0) <= INLINE:
                    levels[c] = [r["level"] for r in mine.orderBy("first", "level").collect()]
                else:
                    ranged = lambda d: d.withColumn(BUCKET, text_bucket(d, "first")) if dict(d.dtypes)["first"] == "string" else with_range_bucket(d, "first")
                    tables[c] = row_index(mine, [], ["first", "level"], ranged, "code", largest=sizes[c]).select("level", "code")
        return Encoder(dict(kinds), levels, tables)

    def columns(self) -> list[tuple[str, str, str, str | None, Column]]:
        """(out column, source, type, level, expression)."""
        out = []
        for c, kind in self.kinds.items():
            s = F.col(c).cast("string")
            if kind == "onehot":
                for level in self.levels[c][1:]:
                    flag = F.when(F.col(c).isNotNull(), (s == level).cast("double"))
                    out.append((f"{c}_{level}", c, "onehot", level, flag))
            elif c in self.tables:
                out.append((c, c, "ordinal", None, F.col(f"__code_{c}").cast("double")))
            elif kind == "ordinal":
                code = F.array_position(F.array(*[F.lit(x) for x in self.levels[c]]), s) - 1
                out.append((c, c, "ordinal", None, F.when(code >= 0, code.cast("double"))))
            elif kind == "passthrough":
                out.append((c, c, "passthrough", None, F.col(c)))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.kinds]
        for c, table in self.tables.items():
            known = table.select(F.col("level").alias(f"__level_{c}"), F.col("code").alias(f"__code_{c}"))
            df = df.join(known, F.col(c).cast("string") == F.col(f"__level_{c}"), "left")
        return df.select(*keep, *[e.alias(name) for name, *_, e in self.columns()])

    def meta(self, spark, numeric: Sequence[str] = ()) -> DataFrame:
        """Where each output column comes from."""
        rows = [(c, c, "numeric", None) for c in numeric] + [(o, s, t, lv) for o, s, t, lv, _ in self.columns()]
        return spark.createDataFrame(rows, "out_col string, source_col string, type string, level string")


def impute_categorical(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Mode-fill only the columns the metadata calls one-hot or ordinal."""
    coded = meta.where(F.col("type").isin("onehot", "ordinal")).select("out_col").distinct().collect()
    columns = [c for c in df.columns if c in {r["out_col"] for r in coded}]
    return impute(df, modes(df, columns)) if columns else df

"""Feature pruning and ranking over the lineitem matrix."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.functions.hashing import hash_mod
from cohortry.operators import select
from cohortry.plans import matrix_sql as msql
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import FEATURES, V, VECTOR, with_views

CONST = ["zero", "pi", "per_group", "half", "mostly", "noise"]


def const_view(spark, folder):
    """Columns constant everywhere, within groups, in half of the groups, or mostly."""
    m = V(spark, folder).matrix()
    draw = (hash_mod(1000, "noise", F.col("row_id")) / 1000.0).cast("double")
    return m.select(
        "row_id", "group_id", "y",
        F.lit(0.0).alias("zero"), F.lit(math.pi).alias("pi"), F.col("group_id").cast("double").alias("per_group"),
        F.when(F.col("group_id") % 2 == 0, 1.0).otherwise(draw).alias("half"),
        F.when(hash_mod(50, "mostly", F.col("row_id")) != 0, 1.0).otherwise(draw).alias("mostly"),
        draw.alias("noise"),
    )


CX = """cx AS (SELECT row_id, group_id, y, 0.0::DOUBLE AS zero, pi() AS pi, group_id::DOUBLE AS per_group,
    CASE WHEN group_id % 2 = 0 THEN 1.0 ELSE d END AS half,
    CASE WHEN ('0x'||substr(md5('mostly:'||row_id),1,8))::BIGINT % 50 <> 0 THEN 1.0 ELSE d END AS mostly, d AS noise
    FROM (SELECT *, (('0x'||substr(md5('noise:'||row_id),1,8))::BIGINT % 1000) / 1000.0::DOUBLE AS d FROM mx)),
  cl AS (SELECT group_id, feature, value FROM cx UNPIVOT (value FOR feature IN (zero, pi, per_group, half, mostly, noise)))"""


def _const_sql(tol):
    return with_views(
        "mx",
        f"""SELECT feature, max(c) / sum(c) AS top_share, CAST(sum(c) AS BIGINT) AS n FROM
          (SELECT feature, value, count(*) AS c FROM cl GROUP BY ALL) GROUP BY feature HAVING max(c) / sum(c) >= {tol}""",
        CX,
    ).replace("max(c) / sum(c) AS", "round(max(c)::DOUBLE / sum(c)::DOUBLE, 9) AS")


@query("const_global", _const_sql(1.0))
def const_global(spark, folder):
    return select.constant_features(const_view(spark, folder), CONST).withColumn("top_share", F.round("top_share", 9))


@query("quasi_const", _const_sql(0.97))
def quasi_const(spark, folder):
    d = select.constant_features(const_view(spark, folder), CONST, tol=0.97, missing="include")
    return d.withColumn("top_share", F.round("top_share", 9))


def _local_sql(frac, test="min(value) = max(value)"):
    return with_views(
        "mx",
        f"""SELECT feature, {R('avg(c)')} AS constant_share, count(*) AS n_groups FROM (SELECT group_id, feature,
          CAST({test} AS DOUBLE) AS c FROM cl GROUP BY ALL HAVING count(*) >= 5) GROUP BY feature HAVING avg(c) >= {frac}""",
        CX,
    )


@query("const_local", _local_sql(0.5))
def const_local(spark, folder):
    d = select.locally_constant_features(const_view(spark, folder), CONST, min_rows=5, local_frac=0.5)
    return d.withColumn("constant_share", r6(F.col("constant_share")))


@query("const_local_all", _local_sql(1.0))
def const_local_all(spark, folder):
    d = select.locally_constant_features(const_view(spark, folder), CONST, min_rows=5)
    return d.withColumn("constant_share", r6(F.col("constant_share")))


@query(
    "drop_constant",
    with_views("mx", "SELECT row_id, mostly, noise FROM cx", CX),
)
def drop_constant(spark, folder):
    d = const_view(spark, folder)
    kept = select.drop_constant(d, CONST, "both", local_frac=0.4, min_rows=5)
    return d.select("row_id", *kept)


# ------------------------------------------------------------------ sampling

BOOTS = 8
NUM = """nm AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY md5('order:' || row_id)) - 1 AS rn,
    count(*) OVER (PARTITION BY group_id) AS n FROM mx),
  bs AS (SELECT nm.*, b AS boot FROM nm, range({boots}) t(b)
    WHERE rn = ('0x'||substr(md5('{seed}:' || b || ':' || group_id),1,8))::BIGINT % n)"""


@query("one_row_per_group", with_views("mx", "SELECT group_id, row_id, y, price FROM bs", NUM.format(boots=1, seed=7)))
def one_row_per_group(spark, folder):
    d = select.one_row_per_group(V(spark, folder).matrix(), seed=7)
    return d.select("group_id", "row_id", "y", "price")


@query(
    "bootstrap_rows",
    with_views("mx", "SELECT CAST(boot AS INTEGER) AS boot, group_id, row_id, y, price FROM bs", NUM.format(boots=BOOTS, seed=0)),
)
def bootstrap_rows(spark, folder):
    return select.bootstrap_rows(V(spark, folder).matrix(), BOOTS).select("boot", "group_id", "row_id", "y", "price")


# --------------------------------------------------------------- correlation


def corr_sql(src: str, cols, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            group = f" GROUP BY {keys}" if keys else ""
            parts.append(f"SELECT {k}'{a}' AS feature_a, '{b}' AS feature_b, coalesce(corr({a}, {b}), 0) AS r FROM {src}{group}")
    return " UNION ALL ".join(parts)


RANKS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {{p}} ORDER BY {c}) + (count(*) OVER (PARTITION BY {{q}} {c}) - 1) / 2.0::DOUBLE END AS {c}"
    for c in FEATURES
)
RANK_ALL = "rk AS (SELECT " + RANKS.format(p="1", q="") + " FROM mx)"
RANK_BOOT = "rk AS (SELECT boot, " + RANKS.format(p="boot", q="boot,") + " FROM bs)"


@query("corr_pearson", with_views("mxn", f"SELECT feature_a, feature_b, {R('r')} AS r FROM ({corr_sql('mxn', FEATURES)})"))
def corr_pearson(spark, folder):
    d = select.correlation_pairs(V(spark, folder).missing(), FEATURES, "pearson")
    return d.withColumn("r", r6(F.col("r")))


@query("corr_spearman", with_views("mx", f"SELECT feature_a, feature_b, {R('r')} AS r FROM ({corr_sql('rk', FEATURES)})", RANK_ALL))
def corr_spearman(spark, folder):
    d = select.correlation_pairs(V(spark, folder).matrix(), FEATURES, "spearman")
    return d.withColumn("r", r6(F.col("r")))


def _kendall_sql(src: str, pairs) -> str:
    """Mean absolute tau-b over bootstraps, all pairs of rows compared."""
    one = lambda a, b: f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, avg(abs(coalesce(s / nullif(sqrt(nx * ny), 0), 0))) AS r FROM (
      SELECT p.boot, sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) AS s, sum(CAST(p.{a} <> q.{a} AS DOUBLE)) AS nx, sum(CAST(p.{b} <> q.{b} AS DOUBLE)) AS ny
      FROM {src} p JOIN {src} q ON p.boot = q.boot AND p.row_id < q.row_id GROUP BY p.boot)"""  # noqa: E731
    return " UNION ALL ".join(one(a, b) for a, b in pairs)


@query(
    "kendall_grouped",
    with_views("mx", f"SELECT feature_a, feature_b, {R('r')} AS r FROM ({_kendall_sql('bs', list(combinations(FEATURES, 2)))})", NUM.format(boots=BOOTS, seed=0)),
)
def kendall_grouped(spark, folder):
    return select.grouped_pairs(V(spark, folder).matrix(), FEATURES, BOOTS, "kendall").withColumn("r", r6(F.col("r")))


@query(
    "collinear_pairs",
    with_views("mx", f"SELECT feature_a, feature_b, {R('abs(r)')} AS r FROM ({corr_sql('mx', FEATURES)}) WHERE abs(r) >= 0.6"),
)
def collinear_pairs(spark, folder):
    pairs = select.correlation_pairs(V(spark, folder).matrix(), FEATURES, "pearson")
    return select.collinear_pairs(pairs, 0.6).withColumn("r", r6(F.col("r")))


@query(
    "collinear_prune",
    with_views(
        "mx",
        f"""SELECT feature_b AS removed, feature_a AS kept, {R('abs(r)')} AS r FROM ({corr_sql('rk', FEATURES)})
          WHERE abs(r) >= 0.6 AND feature_b = 'net' AND feature_a = 'quantity'
          UNION ALL SELECT feature_b, feature_a, {R('abs(r)')} FROM ({corr_sql('rk', FEATURES)})
          WHERE abs(r) >= 0.6 AND feature_a = 'price'""",
        RANK_ALL,
    ),
)
def collinear_prune(spark, folder):
    pairs = select.correlation_pairs(V(spark, folder).matrix(), FEATURES, "spearman")
    return select.greedy_prune(pairs, FEATURES, 0.6)[1].withColumn("r", r6(F.col("r")))


@query(
    "collinear_prune_grouped",
    with_views(
        "mx",
        f"""SELECT feature_b AS removed, feature_a AS kept, {R('avg(abs(r))')} AS r FROM ({corr_sql('rk', FEATURES, 'boot')})
          WHERE feature_a = 'price' GROUP BY ALL HAVING avg(abs(r)) >= 0.8""",
        NUM.format(boots=BOOTS, seed=0) + ", " + RANK_BOOT,
    ),
)
def collinear_prune_grouped(spark, folder):
    pairs = select.grouped_pairs(V(spark, folder).matrix(), FEATURES, BOOTS)
    return select.greedy_prune(pairs, FEATURES, 0.8)[1].withColumn("r", r6(F.col("r")))


def _vif_of(inverses: str, columns) -> str:
    """(feature, vif) from the diagonal of one inverse matrix."""
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    return f"SELECT {names}[i] AS feature, a[i][i] AS vif FROM {inverses}, range(1, {len(columns) + 1}) t(i)"


def _vif_table_sql(view: str, columns, cond: str = "") -> str:
    table = f"SELECT feature, {R('vif', 4)} AS vif, {R('1 / vif')} AS tolerance FROM ({_vif_of('iv', columns)})"
    return with_views(view, table, f"cr AS (SELECT * FROM {view} {cond}), " + msql.inverse("iv", "cr", columns))


@query("vif_table", _vif_table_sql("mxn", FEATURES, "WHERE price IS NOT NULL AND tax IS NOT NULL AND net IS NOT NULL"))
def vif_table(spark, folder):
    d = select.vif_table(V(spark, folder).missing(), FEATURES)
    return d.withColumns({"vif": r6(F.col("vif"), 4), "tolerance": r6(F.col("tolerance"))})


STEPS = f"SELECT step, removed, {R('vif', 4)} AS vif FROM el"


@query(
    "vif_prune",
    with_views("mx", STEPS, msql.inverse("iv", "mx", FEATURES) + ", bl AS (SELECT [a] AS bs FROM iv), " + msql.elimination("el", "bl", FEATURES, 5.0)),
)
def vif_prune(spark, folder):
    return select.vif_prune(V(spark, folder).matrix(), FEATURES, 5.0)[1].withColumn("vif", r6(F.col("vif"), 4))


@query(
    "vif_prune_grouped",
    with_views(
        "mx",
        STEPS,
        NUM.format(boots=BOOTS, seed=0) + ", " + msql.inverse("iv", "bs", FEATURES, "boot") + ", bl AS (SELECT list(a ORDER BY boot) AS bs FROM iv), " + msql.elimination("el", "bl", FEATURES, 5.0),
    ),
)
def vif_prune_grouped(spark, folder):
    d = select.vif_prune_grouped(V(spark, folder).matrix(), FEATURES, BOOTS, 5.0)[1]
    return d.withColumn("vif", r6(F.col("vif"), 4))


# ------------------------------------------------------------- wide tables

WIDE_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in VECTOR) + " FROM vec)"


def _wide_sql(src: str, more: str = "") -> str:
    """All pairs of the vector columns from one list of correlations."""
    names = "[" + ", ".join(f"'{c}'" for c in VECTOR) + "]"
    body = f"""SELECT {names}[i] AS feature_a, {names}[j] AS feature_b, {R('m[i][j]')} AS r
      FROM cm, range(1, {len(VECTOR) + 1}) s(i), range(1, {len(VECTOR) + 1}) t(j) WHERE i < j"""
    return with_views("vec", body, (more + ", " if more else "") + f"cm AS MATERIALIZED (SELECT {msql.correlations(VECTOR)} AS m FROM {src})")


@query("corr_wide_pearson", _wide_sql("vec"))
def corr_wide_pearson(spark, folder):
    return select.correlation_pairs(V(spark, folder).vectors(), VECTOR, "pearson", "vec_id").withColumn("r", r6(F.col("r")))


@query("corr_wide_spearman", _wide_sql("rk", WIDE_RANKS))
def corr_wide_spearman(spark, folder):
    return select.correlation_pairs(V(spark, folder).vectors(), VECTOR, "spearman", "vec_id").withColumn("r", r6(F.col("r")))


@query("vif_wide", _vif_table_sql("vec", VECTOR))
def vif_wide(spark, folder):
    d = select.vif_table(V(spark, folder).vectors(), VECTOR)
    return d.withColumns({"vif": r6(F.col("vif"), 4), "tolerance": r6(F.col("tolerance"))})


@query(
    "vif_prune_wide",
    with_views("vec", STEPS, msql.inverse("iv", "vec", VECTOR) + ", bl AS (SELECT [a] AS bs FROM iv), " + msql.elimination("el", "bl", VECTOR, 1.1)),
)
def vif_prune_wide(spark, folder):
    return select.vif_prune(V(spark, folder).vectors(), VECTOR, 1.1)[1].withColumn("vif", r6(F.col("vif"), 4))


@query(
    "feature_prune",
    with_views("mx", "SELECT row_id, mostly, noise FROM cx", CX),
)
def feature_prune(spark, folder):
    d = const_view(spark, folder)
    kept, _ = select.prune_features(d, CONST, {"mode": "both", "local_frac": 0.4, "min_rows": 5}, {"method": "pearson", "threshold": 0.8})
    return d.select("row_id", *kept)

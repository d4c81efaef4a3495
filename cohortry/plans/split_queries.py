"""Cross-validation plans over orders (row = order, group = customer)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import splits
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import V
from cohortry.sources.tables import spread

TRIALS, OUTER, INNER = 2, 5, 3


def rows(spark, folder):
    """Orders as rows; the label is the customer's, so a group has one label."""
    o = spread(V(spark, folder).table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("group_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


RW = "rw AS (SELECT o_orderkey AS row_id, o_custkey AS group_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"
TR = "tr AS (SELECT rw.*, trial FROM rw, (VALUES (0), (1)) t(trial))"
KF = """kf AS (SELECT trial, row_id, group_id, y, CAST(1 + (row_number() OVER (PARTITION BY trial, y
  ORDER BY md5('outer:' || trial || ':' || row_id)) - 1) % 5 AS INTEGER) AS outer_fold FROM tr)"""


def group_fold_sql(src: str, cells: str, seed: str, k: int, name: str) -> str:
    key = " || ':' || ".join([f"'{seed}'", *[c.strip() for c in cells.split(",")], "group_id"])
    return f"""(SELECT {cells}, group_id, CAST(1 + CASE WHEN i % {2 * k} < {k} THEN i % {2 * k} ELSE {2 * k - 1} - i % {2 * k} END
      AS INTEGER) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {cells}, lab ORDER BY size DESC, md5({key})) - 1 AS i
      FROM (SELECT {cells}, group_id, arg_min(y, (-n, y)) AS lab, sum(n) AS size FROM
        (SELECT {cells}, group_id, y, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY ALL)))"""


SK = f"sk AS (SELECT * FROM tr JOIN {group_fold_sql('tr', 'trial', 'outer', 5, 'outer_fold')} USING (trial, group_id))"
NS_BASE = """ex AS (SELECT {src}.* EXCLUDE (outer_fold), outer_fold AS test_fold, CAST(f AS INTEGER) AS outer_fold FROM {src}, range(1, 6) t(f)),
  trn AS (SELECT * FROM ex WHERE outer_fold <> test_fold)"""
NS = f"""{NS_BASE.format(src='kf')}, ns AS (
  SELECT trial, outer_fold, NULL::INTEGER AS inner_fold, row_id, y, group_id, 'outer_test' AS role FROM ex WHERE outer_fold = test_fold
  UNION ALL SELECT trial, outer_fold, CAST(1 + (row_number() OVER (PARTITION BY trial, outer_fold, y
    ORDER BY md5('inner:' || trial || ':' || outer_fold || ':' || row_id)) - 1) % 3 AS INTEGER), row_id, y, group_id, 'outer_train' FROM trn)"""
NG = f"""{NS_BASE.format(src='sk')}, ng AS (
  SELECT trial, outer_fold, NULL::INTEGER AS inner_fold, row_id, y, group_id, 'outer_test' AS role FROM ex WHERE outer_fold = test_fold
  UNION ALL SELECT trial, outer_fold, inner_fold, row_id, y, group_id, 'outer_train' FROM trn
    JOIN {group_fold_sql('trn', 'trial, outer_fold', 'inner', 3, 'inner_fold')} USING (trial, outer_fold, group_id))"""
ROW_PLAN = f"WITH {RW}, {TR}, {KF}, {NS} "
GROUP_PLAN = f"WITH {RW}, {TR}, {SK}, {NG} "


def row_plan(spark, folder):
    """Row-level plan, with the group carried along for the leakage report."""
    d = rows(spark, folder)
    plan = splits.nested_splits(d, OUTER, INNER, TRIALS, carry=["group_id"])
    return plan.select("row_id", "trial", "outer_fold", "inner_fold", "y", "role", "group_id")


def group_plan(spark, folder):
    return splits.nested_splits(rows(spark, folder), OUTER, INNER, TRIALS, group="group_id")


@query("strat_kfold", f"WITH {RW}, {TR}, {KF} SELECT * FROM kf")
def strat_kfold(spark, folder):
    return splits.strat_kfold(rows(spark, folder), OUTER, TRIALS)


@query("strat_group_kfold", f"WITH {RW}, {TR}, {SK} SELECT * FROM sk")
def strat_group_kfold(spark, folder):
    return splits.strat_group_kfold(rows(spark, folder), OUTER, TRIALS)


@query("nested_splits", ROW_PLAN + "SELECT * FROM ns")
def nested_splits(spark, folder):
    return row_plan(spark, folder)


@query("nested_group_splits", GROUP_PLAN + "SELECT * FROM ng")
def nested_group_splits(spark, folder):
    return group_plan(spark, folder)


@query(
    "inner_roles",
    GROUP_PLAN
    + """SELECT trial, outer_fold, CAST(f AS INTEGER) AS inner_fold, CASE WHEN f = inner_fold THEN 'inner_val' ELSE 'inner_train' END AS role,
      count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM ng, range(1, 4) t(f) WHERE role = 'outer_train' GROUP BY ALL""",
)
def inner_roles(spark, folder):
    d = splits.inner_roles(group_plan(spark, folder), INNER)
    return d.groupBy("trial", "outer_fold", "inner_fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups")
    )


def leak_sql(t: str) -> str:
    return f"""SELECT trial, outer_fold, count(*) AS n_groups, CAST(sum(t * r) AS BIGINT) AS outer_leaks, count(*) FILTER (folds > 1) AS inner_leaks
      FROM (SELECT trial, outer_fold, group_id, max(CAST(role = 'outer_test' AS INTEGER)) AS t,
        max(CAST(role = 'outer_train' AS INTEGER)) AS r, count(DISTINCT inner_fold) AS folds FROM {t} GROUP BY ALL) GROUP BY ALL"""


@query("leakage_check", ROW_PLAN + leak_sql("ns"))
def leakage_check(spark, folder):
    return splits.leakage_check(row_plan(spark, folder))


@query("leakage_check_groups", GROUP_PLAN + leak_sql("ng"))
def leakage_check_groups(spark, folder):
    return splits.leakage_check(group_plan(spark, folder))


@query(
    "coverage_check",
    GROUP_PLAN
    + """SELECT trial, count(*) AS n_rows, count(*) FILTER (n <> 1) AS n_bad_rows FROM
      (SELECT trial, row_id, count(*) FILTER (role = 'outer_test') AS n FROM ng GROUP BY ALL) GROUP BY trial""",
)
def coverage_check(spark, folder):
    return splits.coverage_check(group_plan(spark, folder))


@query(
    "fold_label_stats",
    GROUP_PLAN
    + f"""SELECT trial, outer_fold, role, y, count(*) AS n, {R('100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY trial, outer_fold, role)')}
      AS percent FROM ng GROUP BY trial, outer_fold, role, y""",
)
def fold_label_stats(spark, folder):
    return splits.fold_label_stats(group_plan(spark, folder)).withColumn("percent", r6(F.col("percent")))


@query(
    "split_sizes",
    GROUP_PLAN
    + f"""SELECT trial, outer_fold, role, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups,
      CASE WHEN role = 'outer_train' THEN {R('count(*) / 3.0::DOUBLE')} END AS mean_inner_val,
      CASE WHEN role = 'outer_train' THEN {R('count(*) - count(*) / 3.0::DOUBLE')} END AS mean_inner_train FROM ng GROUP BY trial, outer_fold, role""",
)
def split_sizes(spark, folder):
    d = splits.split_sizes(group_plan(spark, folder))
    return d.withColumns({c: r6(F.col(c)) for c in ("mean_inner_val", "mean_inner_train")})


@query(
    "mixed_label_groups",
    f"WITH {RW} SELECT group_id, count(DISTINCT y) AS n_labels, count(*) AS n_rows FROM rw GROUP BY 1 HAVING count(DISTINCT y) > 1",
)
def mixed_label_groups(spark, folder):
    return splits.mixed_label_groups(rows(spark, folder))


@query(
    "outer_class_percent",
    GROUP_PLAN
    + f"""SELECT trial, outer_fold, role, count(*) FILTER (y = 0) AS n_0, count(*) FILTER (y = 1) AS n_1,
      {R('100.0::DOUBLE * count(*) FILTER (y = 0) / count(*)')} AS percent_0, {R('100.0::DOUBLE * count(*) FILTER (y = 1) / count(*)')} AS percent_1
      FROM ng GROUP BY ALL""",
)
def outer_class_percent(spark, folder):
    d = splits.outer_class_percent(group_plan(spark, folder), [0, 1])
    return d.withColumns({c: r6(F.col(c)) for c in ("percent_0", "percent_1")})


@query(
    "materialize_fold",
    GROUP_PLAN
    + """SELECT row_id, o_totalprice AS total, role, inner_fold FROM ng JOIN orders ON row_id = o_orderkey WHERE trial = 1 AND outer_fold = 2""",
)
def materialize_fold(spark, folder):
    o = V(spark, folder).table("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("total"))
    return splits.materialize_fold(o, group_plan(spark, folder), 1, 2)


@query(
    "split_manifest",
    GROUP_PLAN
    + """SELECT count(DISTINCT trial) AS n_trials, count(DISTINCT outer_fold) AS n_outer_folds, count(DISTINCT inner_fold) AS n_inner_folds,
      count(*) FILTER (role = 'outer_test') AS n_test_rows, count(*) FILTER (role = 'outer_train') AS n_train_rows FROM ng""",
)
def split_manifest(spark, folder):
    return splits.split_manifest(group_plan(spark, folder))

"""Column choice, joins, stacking and group aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.functions.curves import interp_grid, linspace
from cohortry.functions.rows import keep_first
from cohortry.operators import assemble, prep
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import FEATURES, V, with_views
from cohortry.table import FeatureTable

KEYS = "row_id, group_id, y"


def table(spark, folder) -> FeatureTable:
    return FeatureTable.of(V(spark, folder).matrix(), FEATURES)


def _rounded(df, names, digits=4):
    return df.withColumns({c: r6(F.col(c), digits) for c in names})


@query("keep_features", with_views("mx", f"SELECT {KEYS}, tax, price FROM mx"))
def keep_features(spark, folder):
    return assemble.keep_features(table(spark, folder), names=["tax", "price", "tax"]).df


@query("keep_first_features", with_views("mx", f"SELECT {KEYS}, quantity, price, discount FROM mx"))
def keep_first_features(spark, folder):
    return assemble.keep_features(table(spark, folder), n=3).df


@query("drop_features", with_views("mx", f"SELECT {KEYS}, quantity, discount, tax, shipday FROM mx"))
def drop_features(spark, folder):
    return assemble.drop_features(table(spark, folder), ["price", "net", "unknown"]).df


@query("select_ranked", with_views("mx", f"SELECT {KEYS}, shipday, tax FROM mx"))
def select_ranked(spark, folder):
    ranking = spark.createDataFrame([("tax", 1), ("shipday", 0), ("price", 2)], "feature string, rank int")
    return assemble.select_ranked(table(spark, folder), ranking, 2).df


@query(
    "count_feature_cols",
    "SELECT code, count(*) FILTER (contains(feature, code)) AS n_columns FROM (SELECT DISTINCT p_brand || '_' || p_type AS feature "
    "FROM part), (VALUES ('Brand#1'), ('ECONOMY'), ('SMALL_'), ('none')) t(code) GROUP BY code",
)
def count_feature_cols(spark, folder):
    features = V(spark, folder).table("part").select(F.concat_ws("_", "p_brand", "p_type").alias("feature")).distinct()
    codes = spark.createDataFrame([("Brand#1",), ("ECONOMY",), ("SMALL_",), ("none",)], "code string")
    return assemble.count_feature_columns(features, codes)


@query("combine_families", with_views("mx", "SELECT row_id, group_id, quantity, price, discount, tax FROM mx"))
def combine_families(spark, folder):
    m = V(spark, folder).matrix()
    keys = ["row_id", "group_id"]
    return assemble.combine_families([m.select(*keys, "quantity", "price"), m.select(*keys, "discount", "tax")], keys)


@query(
    "concat_left_aligned",
    with_views("mxn", "SELECT row_id, quantity, CASE WHEN price IS NOT NULL THEN discount END AS discount FROM mxn"),
)
def concat_left_aligned(spark, folder):
    m = V(spark, folder).missing()
    other = m.where("price IS NOT NULL").select("row_id", "discount")
    return assemble.concat_left_aligned(m.select("row_id", "quantity"), [other], ["row_id"])


def presence(v: V):
    return v.table("events").select(F.col("user_id").alias("subject_id"), F.concat("event_type", F.dayofmonth("ts")).alias("feature"))


PRESENCE = "ps AS (SELECT user_id AS subject_id, event_type || date_part('day', ts) AS feature FROM events)"


@query(
    "common_features",
    """WITH ps AS (SELECT user_id AS subject_id, event_type AS feature FROM events)
      SELECT feature, count(DISTINCT subject_id) AS n_subjects FROM ps GROUP BY feature
      HAVING count(DISTINCT subject_id) = (SELECT count(DISTINCT subject_id) FROM ps)""",
)
def common_features(spark, folder):
    e = V(spark, folder).table("events")
    return assemble.common_features(e.select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("feature")))


@query(
    "missing_features",
    f"""WITH {PRESENCE} SELECT subject_id, count(*) AS n_missing, string_agg(feature, ',' ORDER BY feature) AS missing
      FROM (SELECT s.subject_id, f.feature FROM (SELECT DISTINCT subject_id FROM ps) s, (SELECT DISTINCT feature FROM ps) f
        EXCEPT SELECT subject_id, feature FROM ps) GROUP BY subject_id""",
)
def missing_features(spark, folder):
    return assemble.missing_features(presence(V(spark, folder)))


@query(
    "stack_groups",
    with_views(
        "doc",
        """SELECT label, doc_id, y, n_chars, row_number() OVER (ORDER BY label, CAST(doc_id AS VARCHAR)) - 1 AS group_id
          FROM doc""",
    ),
)
def stack_groups(spark, folder):
    d = V(spark, folder).documents().select("label", "doc_id", "y", "n_chars")
    return assemble.stack_groups([d.where("y = 0"), d.where("y = 1")], subject="doc_id")


@query(
    "label_map",
    "SELECT c_mktsegment AS label, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_id "
    "FROM (SELECT DISTINCT c_mktsegment FROM customer)",
)
def label_map(spark, folder):
    return assemble.label_map(V(spark, folder).table("customer").select(F.col("c_mktsegment").alias("label")))


SUBJECTS = """sl AS (SELECT trim(' ' || o_custkey) AS sid, min(o_orderkey) AS ord FROM orders GROUP BY 1),
  lf AS (SELECT sid, ord, o_totalprice AS total FROM sl JOIN orders ON ord = o_orderkey),
  rt AS (SELECT trim(CAST(c_custkey AS VARCHAR) || ' ') AS sid, c_acctbal AS balance FROM customer WHERE c_custkey % 7 <> 0)"""


def _subject_sides(v: V):
    left = v.table("orders").select(
        F.concat(F.lit(" "), F.col("o_custkey")).alias("sid"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("total")
    )
    right = v.table("customer").where("c_custkey % 7 <> 0").select(
        F.concat(F.col("c_custkey"), F.lit(" ")).alias("sid"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("balance")
    )
    return left, right


@query("subject_merge", f"WITH {SUBJECTS} SELECT sid, ord, total, balance FROM lf LEFT JOIN rt USING (sid)")
def subject_merge(spark, folder):
    left, right = _subject_sides(V(spark, folder))
    return assemble.subject_merge(keep_first(left, ["sid"], [F.col("ord")]), right, "sid", "ord")


@query(
    "merge_stats",
    f"""WITH {SUBJECTS} SELECT n_left, n_right, n_matched, n_left - n_matched AS n_left_only, n_right - n_matched AS n_right_only,
      {R('n_matched::DOUBLE / n_left')} AS match_rate FROM (SELECT (SELECT count(*) FROM lf) AS n_left, (SELECT count(*) FROM rt)
      AS n_right, (SELECT count(*) FROM lf JOIN rt USING (sid)) AS n_matched)""",
)
def merge_stats(spark, folder):
    return _rounded(assemble.merge_stats(*_subject_sides(V(spark, folder)), "sid"), ["match_rate"], 6)


@query(
    "append_subject_covariates",
    """WITH lv AS (SELECT c_mktsegment AS level, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code FROM customer GROUP BY 1)
      SELECT o_orderkey AS row_id, o_custkey AS group_id, o_totalprice AS total, CAST(code AS DOUBLE) AS segment, c_acctbal AS balance
      FROM orders LEFT JOIN (SELECT * FROM customer JOIN lv ON level = c_mktsegment WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey""",
)
def append_subject_covariates(spark, folder):
    v = V(spark, folder)
    rows = v.table("orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("group_id"), F.col("o_totalprice").alias("total")
    )
    subjects = v.table("customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    enc = prep.Encoder.fit(subjects, {"segment": "ordinal"}, order="group_id")
    return assemble.append_subject_covariates(rows, subjects.where("group_id % 7 <> 0"), enc.transform)


def _group_query(name, how, expr):
    sel = ", ".join(f"{R(expr(c), 4)} AS {c}" for c in FEATURES)

    @query(name, with_views("mxn", f"SELECT group_id, count(*) AS n_rows, {sel} FROM mxn GROUP BY group_id"))
    def run(spark, folder):
        return _rounded(assemble.aggregate_groups(V(spark, folder).missing(), FEATURES, how), FEATURES)


_group_query("group_mean", "mean", lambda c: f"CASE WHEN count({c}) = count(*) THEN avg({c}) END")
_group_query("group_nanmean", "nanmean", lambda c: f"avg({c})")
_group_query("group_median", "median", lambda c: f"CASE WHEN count({c}) = count(*) THEN quantile_cont({c}, 0.5) END")
_group_query("group_nanmedian", "nanmedian", lambda c: f"quantile_cont({c}, 0.5)")
for _how in ("sum", "min", "max"):
    _group_query(f"group_{_how}", _how, lambda c, h=_how: f"{h}({c})")


@query(
    "group_label",
    with_views(
        "mx",
        """SELECT group_id, arg_min(y, (-n, y)) AS y, count(*) AS n_labels FROM
          (SELECT group_id, y, count(*) AS n FROM mx GROUP BY ALL) GROUP BY group_id""",
    ),
)
def group_label(spark, folder):
    return assemble.group_label(V(spark, folder).matrix())


@query(
    "group_gaps",
    "SELECT g AS group_id FROM range((SELECT max(doc_id) + 1 FROM labels)) t(g) WHERE g NOT IN (SELECT doc_id FROM labels)",
)
def group_gaps(spark, folder):
    return assemble.group_gaps(V(spark, folder).table("labels").select(F.col("doc_id").alias("group_id")))


@query(
    "folder_index",
    r"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY path) - 1 AS label_index,
      row_number() OVER (ORDER BY label, path) - 1 AS global_index FROM (SELECT url || '/' || page_id || '.edf' AS path,
      regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS label, CAST(page_id AS VARCHAR) AS stem FROM
      (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)) WHERE label <> ''""",
)
def folder_index(spark, folder):
    p = V(spark, folder).table("pages")
    url = F.regexp_replace("url", r"[?#].*$", "")
    paths = p.select(F.concat(url, F.lit("/"), F.col("page_id").cast("string"), F.lit(".edf")).alias("path"))
    return assemble.folder_index(paths, F.regexp_extract("path", r"^https?://[^/]+/([a-z]+)/", 1))


@query(
    "interp_grid",
    with_views(
        "mx",
        f"""SELECT group_id, i AS grid_index, g AS grid, {R('CASE WHEN lx IS NULL THEN ry WHEN rx IS NULL THEN ly ELSE ly + (ry - ly) / (rx - lx) * (g - lx) END', 4)}
          AS value FROM (SELECT group_id, i, g,
            max(quantity) FILTER (quantity <= g) AS lx, arg_max(v, quantity) FILTER (quantity <= g) AS ly,
            min(quantity) FILTER (quantity > g) AS rx, arg_min(v, quantity) FILTER (quantity > g) AS ry
            FROM (SELECT group_id, quantity, avg(price) AS v FROM mx GROUP BY ALL),
              (SELECT CAST(r AS INTEGER) AS i, 0.0::DOUBLE + 60.0 * r / 30 AS g FROM range(31) t(r)) GROUP BY ALL)""",
    ),
)
def interp_query(spark, folder):
    curve = V(spark, folder).matrix().groupBy("group_id", "quantity").agg(F.avg("price").alias("v"))
    return _rounded(interp_grid(curve, ["group_id"], "quantity", "v", linspace(0.0, 60.0, 31)), ["value"])

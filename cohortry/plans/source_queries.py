"""Files, ids, labels and saved tables, over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.split_queries import GROUP_PLAN, group_plan
from cohortry.plans.views import FEATURES, V, with_views
from cohortry.sources import bundle, scan
from cohortry.table import FeatureTable

# Relative paths cut from the page addresses: host/lang/number.html
PATHS = r"""ph AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path FROM pages)"""


def paths(spark, folder):
    url = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://", "")
    return V(spark, folder).table("pages").select("page_id", url.alias("path"))


@query(
    "match_hints",
    f"WITH {PATHS} SELECT DISTINCT path FROM ph WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.example\\.com/(?:[^/]+/)*e[^/]/(?:[^/]+/)*[0-9][^/]*$')",
)
def match_hints(spark, folder):
    return scan.match_hints(paths(spark, folder), ["*.example.com", "e?"], "[0-9]*").select("path")


@query(
    "scan_files",
    "SELECT CAST(page_id % 40 AS VARCHAR) AS folder, count(*) > 0 AS filled FROM pages WHERE page_id % 2 = 1 GROUP BY 1",
)
def scan_files(spark, folder):
    """Writes the pages into forty folders, then finds the files below the odd side."""
    root = bundle.scratch_folder(spark)
    n = F.col("page_id")
    side = F.when(n % 2 == 1, "odd").otherwise("even")
    d = V(spark, folder).table("pages").select(side.alias("side"), (n % 40).cast("string").alias("part"), F.col("html").alias("value"))
    d.repartition("side", "part").write.mode("overwrite").partitionBy("side", "part").text(root)
    found = scan.scan_files(spark, root, ["side=odd", "part=*"], "*.txt")
    name = F.regexp_extract("relative", r"part=(\d+)/", 1)
    return found.groupBy(name.alias("folder")).agg((F.sum("length") > 0).alias("filled"))


@query(
    "subject_id_borders",
    f"""WITH {PATHS} SELECT page_id, CASE WHEN instr(s, '_') = 0 OR instr(substr(s, instr(s, '_') + 1), 'x') = 0 THEN s
      ELSE substr(s, 1, instr(s, '_') + instr(substr(s, instr(s, '_') + 1), 'x') - 1) END AS subject_id
      FROM (SELECT page_id, 'sub_' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'x9' END || '_end' AS s FROM ph)""",
)
def subject_id_borders(spark, folder):
    d = paths(spark, folder)
    tail = F.when(F.col("page_id") % 3 == 0, "").otherwise("x9")
    stem = F.concat(F.lit("sub_"), F.col("page_id").cast("string"), tail, F.lit("_end"))
    return d.select("page_id", scan.subject_id_from_borders(stem, ["_", "x"]).alias("subject_id"))


@query(
    "normalize_id",
    rf"""WITH {PATHS} SELECT page_id, CASE WHEN trim(t) = '' THEN NULL WHEN regexp_matches(t, '\d') THEN
      CAST(CAST(regexp_extract(t, '(\d+)', 1) AS HUGEINT) AS VARCHAR) ELSE trim(t) END AS subject_id FROM (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' sub-00' || page_id || '-7' WHEN 1 THEN '  ' WHEN 2 THEN ' abc' ELSE '000' END AS t FROM ph)""",
)
def normalize_id(spark, folder):
    n = F.col("page_id")
    text = (
        F.when(n % 4 == 0, F.concat(F.lit(" sub-00"), n.cast("string"), F.lit("-7")))
        .when(n % 4 == 1, "  ").when(n % 4 == 2, " abc").otherwise("000")
    )
    return paths(spark, folder).select("page_id", scan.normalize_id(text).alias("subject_id"))


META = "mt AS (SELECT DISTINCT c_name AS meta_id FROM customer UNION SELECT DISTINCT 'id-' || n_nationkey FROM nation)"
FILES = """fl AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'run_id-' || (o_custkey % 25) || '.raw' WHEN 1 THEN 'x' || (o_custkey % 25)
  WHEN 2 THEN (o_custkey % 25)::VARCHAR ELSE 'id-' || (o_custkey % 25) || ' id-' || (o_orderkey % 7) END AS file_id FROM orders)"""


@query(
    "resolve_ids",
    rf"""WITH {META}, {FILES}, cd AS (
      SELECT file_id, meta_id, CASE WHEN file_id = meta_id THEN 0
        WHEN contains(file_id, meta_id) AND regexp_matches(file_id, '(^|[^A-Za-z0-9])' || regexp_escape(meta_id) || '([^A-Za-z0-9]|$)') THEN 1
        WHEN contains(meta_id, file_id) AND regexp_matches(meta_id, '(^|[^A-Za-z0-9])' || regexp_escape(file_id) || '([^A-Za-z0-9]|$)') THEN 2 END AS tier FROM fl, mt),
      bt AS (SELECT *, length(meta_id) AS len, min(tier) OVER (PARTITION BY file_id) AS best FROM cd WHERE tier IS NOT NULL),
      lg AS (SELECT *, max(len) OVER (PARTITION BY file_id) AS longest FROM bt WHERE tier = best),
      ch AS (SELECT file_id, CASE WHEN count(*) = 1 THEN min(meta_id) END AS meta_id FROM lg WHERE len = longest GROUP BY 1)
      SELECT file_id, meta_id FROM fl LEFT JOIN ch USING (file_id)""",
)
def resolve_ids(spark, folder):
    v = V(spark, folder)
    metas = v.table("customer").select(F.col("c_name").alias("meta_id")).unionByName(
        v.table("nation").select(F.concat(F.lit("id-"), F.col("n_nationkey").cast("string")).alias("meta_id"))
    )
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 25).cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("run_id-"), c, F.lit(".raw"))).when(k % 4 == 1, F.concat(F.lit("x"), c))
        .when(k % 4 == 2, c).otherwise(F.concat(F.lit("id-"), c, F.lit(" id-"), (k % 7).cast("string")))
    )
    return scan.resolve_ids(v.table("orders").select(name.alias("file_id")), metas)


@query("label_mapping", "SELECT CAST(doc_id AS VARCHAR) AS subject_id, CAST(quality AS VARCHAR) AS label FROM labels")
def label_mapping(spark, folder):
    path = bundle.scratch_folder(spark)
    V(spark, folder).table("labels").write.mode("overwrite").option("header", True).csv(path)
    return scan.label_mapping(spark, path, "doc_id", "quality")


@query(
    "scan_join_status",
    """SELECT page_id, label, CASE WHEN label IS NULL THEN 'unmatched_file_id' ELSE 'matched' END AS match_status FROM (
      SELECT p.page_id, CAST(l.quality AS VARCHAR) AS label FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id)""",
)
def scan_join_status(spark, folder):
    files = paths(spark, folder).withColumn("subject_id", scan.normalize_id(F.concat(F.lit("sub-0"), F.col("page_id").cast("string"))))
    meta = V(spark, folder).table("labels").select(F.col("doc_id").cast("string").alias("subject_id"), F.col("quality").cast("string").alias("label"))
    return scan.join_status(files, meta)[0].select("page_id", "label", "match_status")


@query("scan_unmatched", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def scan_unmatched(spark, folder):
    files = paths(spark, folder).withColumn("subject_id", F.col("page_id").cast("string"))
    meta = V(spark, folder).table("labels").select(F.col("doc_id").cast("string").alias("subject_id"))
    return scan.join_status(files, meta)[1].select("page_id")


RAW = """rw AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'sub-' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '' END || o_custkey END AS raw,
    CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS label FROM orders),
  nk AS (SELECT *, CASE WHEN trim(raw) <> '' THEN CAST(CAST(regexp_extract(raw, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) END AS k FROM rw)"""


def raw_metadata(v: V):
    k = F.col("o_orderkey")
    zero = F.when(k % 2 == 0, "0").otherwise("")
    raw = F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("sub-"), zero, F.col("o_custkey").cast("string")))
    label = F.when(k % 5 == 0, " ").when(k % 7 == 0, None).otherwise(F.col("o_orderstatus"))
    return v.table("orders").select(k.alias("ord"), raw.alias("raw"), label.alias("label"))


@query(
    "metadata_clean",
    f"WITH {RAW} SELECT k AS subject_id_key, arg_min(label, ord) AS label FROM nk WHERE k IS NOT NULL AND trim(coalesce(label, '')) <> '' GROUP BY 1",
)
def metadata_clean(spark, folder):
    return scan.clean_metadata(raw_metadata(V(spark, folder)), "raw", "label", "ord")


@query("id_collisions", f"WITH {RAW} SELECT k AS subject_id_key, count(DISTINCT raw) AS n_raw FROM nk WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT raw) > 1")
def id_collisions(spark, folder):
    return scan.id_collisions(raw_metadata(V(spark, folder)), "raw")


@query(
    "keep_labelled",
    f"""WITH {RAW}, cm AS (SELECT k, arg_min(label, ord) AS label FROM nk WHERE k IS NOT NULL AND trim(coalesce(label, '')) <> '' GROUP BY 1)
      SELECT page_id, label FROM pages JOIN cm ON k = CAST(page_id AS VARCHAR)""",
)
def keep_labelled(spark, folder):
    v = V(spark, folder)
    clean = scan.clean_metadata(raw_metadata(v), "raw", "label", "ord")
    files = v.table("pages").select("page_id", F.concat(F.lit("S"), F.col("page_id").cast("string")).alias("subject_id"))
    return scan.keep_labelled(files, clean)[0].select("page_id", "label")


@query(
    "block_ledger",
    """SELECT c.c_custkey AS subject_id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'UNLABELED' ELSE c_mktsegment END AS label, n_found,
      st AS convert_status, CASE WHEN st = 'converted' THEN least(n_found, 8) END AS n_blocks_used FROM (
      SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'skipped_exists' WHEN n_found IS NULL THEN 'failed' WHEN n_found < 8 THEN 'skipped_insufficient_blocks'
        ELSE 'converted' END AS st FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_found FROM orders GROUP BY 1) ON o_custkey = c_custkey) c""",
)
def block_ledger(spark, folder):
    v = V(spark, folder)
    blocks = v.table("orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count(F.lit(1)).alias("n_found"))
    label = F.when(F.col("c_mktsegment") == "FURNITURE", "  ").otherwise(F.col("c_mktsegment"))
    c = v.table("customer").select(F.col("c_custkey").alias("subject_id"), label.alias("label"))
    return scan.block_ledger(c.join(blocks, "subject_id", "left"), c.where("subject_id % 10 = 0"), 8)


@query(
    "infer_dims",
    """SELECT p_partkey, CASE WHEN three THEN CASE WHEN ns = 1 AND nc = 1 THEN seg END END AS n_segments,
      CASE WHEN three THEN CASE WHEN ns = 1 AND nc = 1 THEN t END ELSE CASE WHEN (a <= 64) <> (b <= 64) THEN greatest(a, b) END END AS n_times,
      CASE WHEN three THEN CASE WHEN ns = 1 AND nc = 1 THEN ch END ELSE CASE WHEN (a <= 64) <> (b <= 64) THEN least(a, b) END END AS n_channels FROM (
      SELECT *, list_filter([a, b, c], lambda x: x <= 8)[1] AS seg, len(list_filter([a, b, c], lambda x: x <= 8)) AS ns,
        len(list_filter([a, b, c], lambda x: x > 8 AND x <= 64)) AS nc, list_filter([a, b, c], lambda x: x > 8 AND x <= 64)[1] AS ch,
        list_filter([a, b, c], lambda x: x > 64)[1] AS t FROM (
        SELECT p_partkey, p_partkey % 2 = 0 AS three, CAST(p_size * 2 AS INTEGER) AS a, CAST(1000 - p_size * 19 AS INTEGER) AS b, CAST(1 + p_partkey % 12 AS INTEGER) AS c FROM part))""",
)
def infer_dims(spark, folder):
    p = V(spark, folder).table("part")
    a, b = (F.col("p_size") * 2).cast("int"), (1000 - F.col("p_size") * 19).cast("int")
    c = (1 + F.col("p_partkey") % 12).cast("int")
    shape = F.when(F.col("p_partkey") % 2 == 0, F.array(a, b, c)).otherwise(F.array(a, b))
    d = p.select("p_partkey", shape.alias("shape")).withColumn("d", scan.infer_dims(F.col("shape"), 64, 8))
    return d.select("p_partkey", "d.n_segments", "d.n_times", "d.n_channels")


@query(
    "durations",
    f"""SELECT p_partkey, CASE WHEN fs > 0 AND p_size > 5 THEN {R('(p_size - 5)::DOUBLE / fs')} END AS seg_dur_second,
      CASE WHEN fs > 0 AND p_size > 5 THEN {R('(p_size - 5)::DOUBLE * greatest(p_partkey % 3, 1) / fs')} END AS total_dur_second
      FROM (SELECT p_partkey, p_size, (p_partkey % 9 - 1)::DOUBLE AS fs FROM part)""",
)
def durations(spark, folder):
    p = V(spark, folder).table("part")
    fs = (F.col("p_partkey") % 9 - 1).cast("double")
    seg, total = scan.durations(F.col("p_size") - 5, F.col("p_partkey") % 3, fs)
    return p.select("p_partkey", r6(seg).alias("seg_dur_second"), r6(total).alias("total_dur_second"))


# --------------------------------------------------------------- round trips


@query("save_load_table", with_views("mx", "SELECT row_id, group_id, y, quantity, price, discount, tax, shipday, net FROM mx"))
def save_load_table(spark, folder):
    d = V(spark, folder).matrix().select("row_id", "group_id", "y", *FEATURES)
    path = bundle.scratch_folder(spark)
    bundle.save_table(FeatureTable.of(d, FEATURES, labels=d.select("y").distinct()), path)
    table = bundle.load_table(spark, path, ["rows", "labels"])
    return table.df.select(*table.keys, *table.features)


@query("save_load_features", with_views("doc", "SELECT label, count(*) AS n FROM doc WHERE label IN ('src1', 'src2') GROUP BY 1"))
def save_load_features(spark, folder):
    path = bundle.scratch_folder(spark)
    bundle.save_features(V(spark, folder).documents(), path)
    return bundle.load_features(spark, path, ["src1", "src2"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("save_load_splits", GROUP_PLAN + "SELECT trial, outer_fold, inner_fold, row_id, role FROM ng")
def save_load_splits(spark, folder):
    path = bundle.scratch_folder(spark)
    bundle.save_splits(group_plan(spark, folder), path, "plan_only")
    return bundle.load_splits(spark, path)[0].select("trial", "outer_fold", "inner_fold", "row_id", "role")


@query("save_load_results", with_views("pred", "SELECT model, variant, split, count(*) AS n, round(sum(p) + 1e-10, 3) AS total FROM pred GROUP BY ALL"))
def save_load_results(spark, folder):
    path = bundle.scratch_folder(spark)
    bundle.save_results(V(spark, folder).predictions(), {}, path)
    d = bundle.load_results(spark, path)[0].groupBy("model", "variant", "split")
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p") + 1e-10, 3).alias("total"))


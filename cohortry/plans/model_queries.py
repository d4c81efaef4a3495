"""Models on labelled documents; interpretation of fixed scores on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.functions.shuffles import MULTIPLIERS, PRIME
from cohortry.operators import interpret as ip, models as ml, prep, scorers, splits
from cohortry.operators.metrics import fold_metrics
from cohortry.plans import matrix_sql as msql
from cohortry.plans.metric_queries import rank_sql
from cohortry.plans.registry import query, rounded as R
from cohortry.plans.views import FEATURES, V, with_views
from cohortry.sources import bundle
from cohortry.sources.tables import spread

TEXT = ["n_chars", "n_words", "n_lines", "n_digits", "n_upper"]
LR = {"maxIter": 30}


def documents(spark, folder):
    """Labelled documents with text measures; group = source."""
    v = V(spark, folder)
    d = spread(v.table("documents"), "doc_id").join(v.table("labels"), "doc_id")
    text = F.col("text")
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("group_id"),
        F.col("quality").alias("y"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("n_words"),
        F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("n_digits"),
        F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("double").alias("n_upper"),
    )


def plan_of(d, outer=3, inner=2):
    return splits.nested_splits(d.select("row_id", "group_id", "y"), outer, inner, 1).persist()


@query("fit_score")
def fit_score(spark, folder):
    d = splits.strat_kfold(documents(spark, folder), 3).persist()
    return ml.fit_score(d.where("outer_fold != 1"), d.where("outer_fold = 1"), TEXT, "logistic", LR)[1]


@query("inner_cv_scores")
def inner_cv_scores(spark, folder):
    d = documents(spark, folder)
    plan = plan_of(d).where("outer_fold = 1 AND role = 'outer_train'").select("row_id", "inner_fold")
    train = d.join(plan, "row_id").persist()
    grid = ml.param_grid({"regParam": [0.0, 0.1], "maxIter": [20]})
    return spark.createDataFrame(ml.inner_cv_scores(train, TEXT, "logistic", grid), "setting int, inner_fold int, train double, test double")


@query("nested_cv_predictions")
def nested_cv_predictions(spark, folder):
    d = documents(spark, folder)
    return ml.nested_cv(d, plan_of(d), TEXT, "logistic", {"regParam": [0.0, 0.1], "maxIter": [20]}, "logistic")[0]


@query("nested_cv_fold_features")
def nested_cv_fold_features(spark, folder):
    d = documents(spark, folder)
    plan = plan_of(d)
    chosen = ml.fold_feature_select(d, plan, TEXT, threshold=0.9)
    out, _ = ml.nested_cv(d, plan, chosen, "forest", {"numTrees": [5], "maxDepth": [3], "seed": [7]}, "forest", max_features=3)
    return fold_metrics(out)


LABELLED = r"""ld AS (SELECT doc_id AS row_id, source AS group_id, quality AS y, n_chars::DOUBLE AS n_chars, len(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'))::DOUBLE AS n_words,
    len(string_split(text, chr(10)))::DOUBLE AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS n_digits,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE AS n_upper FROM documents JOIN labels USING (doc_id)),
  lz AS (SELECT row_id, y, [1.0::DOUBLE, """ + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in TEXT) + "] AS x FROM ld)"
OOF = f"""{LABELLED}, of AS (SELECT *, CAST(1 + (row_number() OVER (PARTITION BY y ORDER BY md5('oof:' || row_id)) - 1) % 3 AS INTEGER) AS oof_fold FROM lz),
  tr AS (SELECT f AS fold, y, x, [0.0::DOUBLE FOR i IN range(6)] AS penalty FROM of, range(1, 4) t(f) WHERE f <> oof_fold), {msql.newton('nw', 'tr', 'fold', 6, 24)}"""


@query(
    "oof_predictions",
    f"WITH RECURSIVE {OOF} SELECT row_id, oof_fold, y, {R('1 / (1 + exp(-list_dot_product(b, x)))', 5)} AS p FROM of JOIN nw ON nw.fold = of.oof_fold",
)
def oof_predictions(spark, folder):
    d = ml.oof_predictions(documents(spark, folder), TEXT, "logistic", LR, 3)
    return d.select("row_id", "oof_fold", "y", r6(F.col("p"), 5).alias("p"))


# ----------------------------------------------- selection inside the folds

FOLDED = ["price", "discount", "net"]
KF = """kf AS (SELECT row_id, 1 + (row_number() OVER (PARTITION BY y ORDER BY md5('outer:0:' || row_id)) - 1) % 3 AS test_fold, price, discount, net FROM mx),
  tn AS (SELECT kf.*, CAST(f AS INTEGER) AS outer_fold FROM kf, range(1, 4) t(f) WHERE f <> test_fold)"""

KF_ALL = KF.replace("price, discount, net FROM", ", ".join(FEATURES) + " FROM")


def fold_plan(m, carry=()):
    """Outer folds only; columns to ``carry`` go along."""
    d = splits.strat_kfold(m.select("row_id", "y", *carry), 3).withColumnRenamed("outer_fold", "test_fold")
    d = d.withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(3))))
    role = F.when(F.col("outer_fold") == F.col("test_fold"), "outer_test").otherwise("outer_train")
    return d.select("trial", "outer_fold", "row_id", role.alias("role"), *carry)


@query(
    "fold_feature_select",
    with_views(
        "mx",
        """SELECT 0 AS trial, outer_fold, CAST(row_number() OVER (PARTITION BY outer_fold ORDER BY pos) - 1 AS INTEGER) AS position, feature FROM (
          SELECT outer_fold, unnest(['price', 'discount', 'net']) AS feature, unnest([0, 1, 2]) AS pos,
            unnest([TRUE, abs(ab) < 0.8, abs(ac) < 0.8 AND (abs(bc) < 0.8 OR abs(ab) >= 0.8)]) AS keep FROM (
            SELECT outer_fold, corr(price, discount) AS ab, corr(price, net) AS ac, corr(discount, net) AS bc FROM tn GROUP BY 1)) WHERE keep""",
        KF,
    ),
)
def fold_feature_select(spark, folder):
    m = V(spark, folder).matrix()
    return ml.features_table(spark, ml.fold_feature_select(m, fold_plan(m, FOLDED), FOLDED))


@query(
    "fold_vif",
    with_views(
        "mx",
        f"SELECT 5.0::DOUBLE AS threshold, 0 AS trial, outer_fold, step, removed, {R('vif', 4)} AS vif FROM el",
        KF_ALL + ", " + msql.inverse("iv", "tn", FEATURES, "outer_fold") + ", bl AS (SELECT outer_fold, [a] AS bs FROM iv), " + msql.elimination("el", "bl", FEATURES, 5.0, "outer_fold"),
    ),
)
def fold_vif(spark, folder):
    m = V(spark, folder).matrix()
    return ml.fold_vif(m, fold_plan(m, FEATURES), FEATURES, (5.0,)).withColumn("vif", r6(F.col("vif"), 4))


# ---------------------------------------------------------- interpretation

COLS = ["quantity", "price", "discount"]
BETAS = {
    "wide": {"quantity": 0.05, "price": 0.00004, "discount": -12.0},
    "narrow": {"quantity": -0.02, "price": 0.00001, "discount": 3.0},
}


def scorer(betas, bias=-1.0):
    """A fixed logistic score, standing in for a fitted model."""

    def score(d):
        eta = sum((F.lit(b) * F.col(c) for c, b in betas.items()), F.lit(bias))
        return d.withColumn("p", F.round(1.0 / (1.0 + F.exp(-eta)), 9))

    return score


def score_sql(betas, cols=None):
    """The same in SQL; ``cols`` replaces columns by expressions."""
    eta = " + ".join(f"{b!r}::DOUBLE * {(cols or {}).get(c, c)}" for c, b in betas.items())
    return f"round(1.0 / (1.0 + exp(-(-1.0::DOUBLE + {eta}))), 9)"


def labelled(spark, folder):
    """Rows with a label that depends on the columns, so that shuffling matters."""
    m = V(spark, folder).matrix()
    return m.select("row_id", (F.col("quantity") + F.col("price") / 2000 - F.col("discount") * 200 > 30).cast("int").alias("y"), *COLS)


LB = "lb AS (SELECT row_id, CAST(quantity + price / 2000 - discount * 200 > 30 AS INTEGER) AS y, quantity, price, discount FROM mx)"


def feistel_sql(seed_rows: str, repeats: int) -> str:
    """Recursive CTE ``pm`` (seed, repeat, r0, x): row numbers under the keyed bijections, walked until they are below n."""
    key = lambda t: f"(('0x'||substr(md5(seed || ':' || repeat || ':{t}'),1,8))::BIGINT % {PRIME})"
    mixed = lambda x, t: f"(({x} % {PRIME} + k{t}) % {PRIME} * {MULTIPLIERS[0]} % {PRIME})"
    part = lambda x, t, m: f"((xor({mixed(x, t)}, {mixed(x, t)} >> 15) * {MULTIPLIERS[1]}) % {PRIME}) & ((1::BIGINT << {m}) - 1)"
    turns = ", ".join(f"{key(t)} AS k{t}" for t in range(4))
    body = "x >> rb AS a, x & ((1::BIGINT << rb) - 1) AS b"
    walk = lambda src: f"""SELECT seed, repeat, r0, n, lb_, rb, k0, k1, k2, k3, (a2 << rb) | b2 AS x FROM (
        SELECT *, xor(b1, {part('a2', 3, 'rb')}) AS b2 FROM (SELECT *, xor(a1, {part('b1', 2, 'lb_')}) AS a2 FROM (
        SELECT *, xor(b, {part('a1', 1, 'rb')}) AS b1 FROM (SELECT *, xor(a, {part('b', 0, 'lb_')}) AS a1 FROM (
        SELECT *, {body} FROM {src}))))) q"""  # noqa: E731
    return f"""sz AS (SELECT n, bits // 2 AS lb_, bits - bits // 2 AS rb FROM (SELECT n, greatest(2, length(ltrim(bin(n - 1), '0'))) AS bits FROM (SELECT count(*) AS n FROM nb))),
      st AS (SELECT s AS seed, repeat, r AS r0, r AS x, n, lb_, rb, {turns} FROM (SELECT s, s AS seed, b AS repeat, r, n, lb_, rb FROM nb, sz, range({repeats}) t(b), (VALUES {seed_rows}) u(s))),
      wk AS ({walk('st')} UNION ALL {walk('wk WHERE x >= n')}), pm AS (SELECT seed, repeat, r0, x FROM wk WHERE x < n)"""


def perm_sql(models: dict, seeds, repeats: int) -> str:
    """CTEs ``im``: (model, seed, feature, repeat, importance) by AUROC."""
    parts, base = [], []
    for name, betas in models.items():
        base.append(f"SELECT '{name}' AS model, y, {score_sql(betas)} AS p FROM lb")
        cases = {c: f"CASE WHEN feature = '{c}' THEN donated ELSE {c} END" for c in COLS}
        parts.append(f"SELECT '{name}' AS model, seed, feature, repeat, y, {score_sql(betas, cases)} AS p FROM cp")
    seed_rows = ", ".join(f"({s})" for s in seeds)
    return f"""{LB}, nb AS (SELECT *, row_number() OVER (ORDER BY md5('base:' || row_id)) - 1 AS r FROM lb),
      {feistel_sql(seed_rows, repeats)},
      dn AS (SELECT seed, feature, CAST(repeat AS INTEGER) AS repeat, x AS r, v AS donated
        FROM (SELECT r AS r0, feature, v FROM nb UNPIVOT (v FOR feature IN ({', '.join(COLS)}))) JOIN pm USING (r0)),
      cp AS (SELECT * FROM nb JOIN dn USING (r)), ba AS ({' UNION ALL '.join(base)}), sh AS ({' UNION ALL '.join(parts)}),
      bm AS (SELECT model, auroc AS b FROM (WITH {rank_sql('ba', 'model', 'p')} SELECT * FROM au)),
      im AS (SELECT model, seed, feature, repeat, b - auroc AS importance FROM (WITH {rank_sql('sh', 'model, seed, feature, repeat', 'p')} SELECT * FROM au) JOIN bm USING (model))"""


ONE = {"wide": BETAS["wide"]}


@query(
    "perm_importance",
    with_views("mx", f"SELECT feature, repeat, {R('importance')} AS importance FROM im", perm_sql(ONE, [0], 3)),
)
def perm_importance(spark, folder):
    d = ip.perm_importance(labelled(spark, folder), scorer(BETAS["wide"]), COLS, 3)
    return d.withColumn("importance", r6(F.col("importance")))


def _two_folds(spark, folder):
    """Importance from two seeds, as if from two folds."""
    d = labelled(spark, folder)
    rows = ip.numbered(d, keep=False)
    out = ip.perm_combined({(0, f): ip.perm_importance(d, scorer(BETAS["wide"]), COLS, 2, seed=f, rows=rows) for f in (1, 2)})
    rows.release()
    return out


@query(
    "perm_combined",
    with_views(
        "mx",
        f"SELECT 0 AS trial, seed AS outer_fold, feature, repeat, {R('importance')} AS importance FROM im",
        perm_sql(ONE, [1, 2], 2),
    ),
)
def perm_combined(spark, folder):
    return _two_folds(spark, folder).withColumn("importance", r6(F.col("importance")))


@query(
    "perm_ranked",
    with_views(
        "mx",
        f"""SELECT feature, {R('m')} AS mean, {R('s')} AS sd, n, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank FROM (
          SELECT feature, avg(importance) AS m, stddev_samp(importance) AS s, count(*) AS n FROM im GROUP BY feature)""",
        perm_sql(ONE, [1, 2], 2),
    ),
)
def perm_ranked(spark, folder):
    d = ip.perm_ranked(_two_folds(spark, folder))
    return d.withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


DRIFT = perm_sql(BETAS, [3, 4], 1)
SUMMARY = """dm AS (SELECT model, seed, avg(importance) AS m FROM im GROUP BY ALL),
  sm AS (SELECT model, feature, avg(importance) AS mean_drift, stddev_samp(importance) AS sd_drift, median(importance) AS median_drift,
    avg(CAST(importance >= m AS DOUBLE)) AS keep_freq FROM im JOIN dm USING (model, seed) GROUP BY model, feature)"""


def drifts(spark, folder):
    scores = {name: scorer(b) for name, b in BETAS.items()}
    return ip.shuffle_drifts(labelled(spark, folder), scores, COLS, [3, 4]).persist()


@query(
    "stability_summary",
    with_views(
        "mx",
        f"SELECT model, feature, {R('mean_drift')} AS mean_drift, {R('sd_drift')} AS sd_drift, {R('median_drift')} AS median_drift, keep_freq FROM sm",
        DRIFT + ", " + SUMMARY,
    ),
)
def stability_summary(spark, folder):
    d = scorers.stability_summary(drifts(spark, folder))[0]
    return d.withColumns({c: r6(F.col(c)) for c in ("mean_drift", "sd_drift", "median_drift")})


@query(
    "stability_overall",
    with_views(
        "mx",
        f"SELECT feature, {R('avg(mean_drift)')} AS mean_drift, avg(keep_freq) AS mean_keep_freq, min(keep_freq) AS min_keep_freq FROM sm GROUP BY feature",
        DRIFT + ", " + SUMMARY,
    ),
)
def stability_overall(spark, folder):
    return scorers.stability_summary(drifts(spark, folder))[1].withColumn("mean_drift", r6(F.col("mean_drift")))


@query(
    "top_features_per_model",
    with_views(
        "mx",
        f"""SELECT model, feature, rank, {R('mean_drift')} AS mean_drift, count(*) OVER (PARTITION BY feature) AS n_models FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY mean_drift DESC, feature) AS INTEGER) AS rank FROM sm)
          WHERE rank <= CASE WHEN model = 'wide' THEN 1 ELSE 2 END""",
        DRIFT + ", " + SUMMARY,
    ),
)
def top_features_per_model(spark, folder):
    per = scorers.stability_summary(drifts(spark, folder))[0]
    return scorers.top_features_per_model(per, {"wide": 1}, 2).withColumn("mean_drift", r6(F.col("mean_drift")))


@query("shuffle_stability")
def shuffle_stability(spark, folder):
    d = splits.strat_kfold(documents(spark, folder), 3).persist()
    train, test = d.where("outer_fold != 1"), d.where("outer_fold = 1")
    fits = {
        "logistic": ml.fit_model(train, TEXT, "logistic", LR),
        "forest": ml.fit_model(train, TEXT, "forest", {"numTrees": 5, "maxDepth": 3, "seed": 1}),
    }
    scores = {n: (lambda x, m=m: ml.score_rows(m, x)) for n, m in fits.items()}
    return scorers.stability_summary(ip.shuffle_drifts(test, scores, TEXT, [0, 1]))[0]


# ------------------------------------------------------------------- pdp

PDP_COLS = ["price", "discount"]
GRID = """gd AS (SELECT 'price' AS feature, CAST(i AS INTEGER) AS grid_index, lo + (hi - lo) * i / 19 AS grid FROM
    (SELECT quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM mx), range(20) t(i)
  UNION ALL SELECT 'discount', CAST(row_number() OVER (ORDER BY discount) - 1 AS INTEGER), discount FROM (SELECT DISTINCT discount FROM mx)),
  pp AS (SELECT feature, fold, grid_index, grid, avg(p) AS value FROM (
    SELECT feature, group_id % 3 AS fold, grid_index, grid, {score} AS p FROM mx, gd) GROUP BY ALL)""".format(
    score=score_sql(BETAS["wide"], {c: f"CASE WHEN feature = '{c}' THEN grid ELSE {c} END" for c in PDP_COLS})
)


def fold_pdp(spark, folder, centered=False):
    m = V(spark, folder).matrix().withColumn("fold", F.col("group_id") % 3)
    grid = ip.pdp_grid(m, PDP_COLS, 20)
    return ip.partial_dependence(m, scorer(BETAS["wide"]), grid, ["fold"], centered)


@query("pdp", with_views("mx", f"SELECT fold, feature, grid_index, {R('grid')} AS grid, {R('value')} AS value FROM pp", GRID))
def pdp(spark, folder):
    return fold_pdp(spark, folder).withColumns({"grid": r6(F.col("grid")), "value": r6(F.col("value"))})


@query(
    "pdp_centered",
    with_views(
        "mx",
        f"""SELECT fold, feature, grid_index, {R('grid')} AS grid,
          {R('value - first_value(value) OVER (PARTITION BY fold, feature ORDER BY grid_index)')} AS value FROM pp""",
        GRID,
    ),
)
def pdp_centered(spark, folder):
    return fold_pdp(spark, folder, True).withColumns({"grid": r6(F.col("grid")), "value": r6(F.col("value"))})


@query("pdp_long", with_views("mx", f"SELECT fold, feature, grid_index, {R('grid')} AS grid, {R('ln(value)')} AS value FROM pp WHERE grid > 0", GRID))
def pdp_long(spark, folder):
    d = fold_pdp(spark, folder).withColumn("value", F.when(F.col("grid") > 0, F.log("value")).otherwise(float("nan")))
    return ip.pdp_long(d).withColumns({"grid": r6(F.col("grid")), "value": r6(F.col("value"))})


MEAN = f"""SELECT feature, grid_index, {R('grid')} AS grid, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS sd, count(value) AS n_folds
  FROM pp GROUP BY feature, grid_index, grid"""


@query("pdp_mean", with_views("mx", MEAN, GRID))
def pdp_mean(spark, folder):
    d = ip.pdp_mean(fold_pdp(spark, folder).persist(), n_points=20, max_unique=12, fold=["fold"])
    return d.withColumns({c: r6(F.col(c)) for c in ("grid", "mean", "sd")})


@query(
    "pdp_raw_units",
    with_views(
        "mx",
        f"""SELECT feature, grid_index, {R('grid', 4)} AS grid, {R('mean')} AS mean, {R("grid * CASE feature WHEN 'price' THEN sp ELSE sd_ END + CASE feature WHEN 'price' THEN mp ELSE md END", 1)} AS grid_raw
          FROM (SELECT feature, grid_index, grid, avg(value) AS mean FROM pp GROUP BY ALL), (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(discount) AS md, stddev_pop(discount) AS sd_ FROM mx)""",
        GRID,
    ),
)
def pdp_raw_units(spark, folder):
    m = V(spark, folder).matrix()
    rows = [(c, mean, sd) for c, (mean, sd) in prep.fit_scale(m, PDP_COLS).items()]
    params = spark.createDataFrame(rows, "feature string, mean double, scale double")
    d = ip.pdp_mean(fold_pdp(spark, folder).persist(), n_points=20, max_unique=12, fold=["fold"])
    d = prep.unscale(d.select("feature", "grid_index", "grid", F.col("mean").alias("m")), params, "grid", "grid_raw")
    return d.select("feature", "grid_index", r6(F.col("grid"), 4).alias("grid"), r6(F.col("m")).alias("mean"), r6(F.col("grid_raw"), 1).alias("grid_raw"))


REPORT_BETAS = {"tax": 9.0, "open": 1.5, "discount": -3.0}
REPORT = """rs AS (SELECT group_id % 3 AS fold, tax, CAST(l_linestatus = 'O' AS DOUBLE) AS open, discount FROM mx),
  rg AS (SELECT DISTINCT fold, 'tax' AS feature, tax AS grid FROM rs UNION ALL SELECT DISTINCT fold, 'open', open FROM rs),
  rp AS (SELECT feature, fold, grid, avg(p) AS value FROM (SELECT feature, rs.fold, grid, {score} AS p FROM rs JOIN rg ON rs.fold = rg.fold) GROUP BY ALL)""".format(
    score=score_sql(REPORT_BETAS, {c: f"CASE WHEN feature = '{c}' THEN grid ELSE {c} END" for c in ("tax", "open")})
)


@query(
    "pdp_report",
    with_views(
        "mx",
        f"""SELECT feature, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY grid) - 1 AS INTEGER) AS grid_index, {R('grid')} AS grid, {R('avg(value)')} AS mean,
          {R('stddev_pop(value)')} AS sd, count(value) AS n_folds FROM rp GROUP BY feature, grid""",
        REPORT,
    ),
)
def pdp_report(spark, folder):
    m = V(spark, folder).matrix().withColumn("open", (F.col("l_linestatus") == "O").cast("double"))
    folds = {(0, k): (m.where(F.col("group_id") % 3 == k), scorer(REPORT_BETAS)) for k in range(3)}
    d = ip.pdp_report(folds, ["tax", "open"])
    return d.select("feature", F.col("grid_index").cast("int").alias("grid_index"), *[r6(F.col(c)).alias(c) for c in ("grid", "mean", "sd")], "n_folds")


@query(
    "save_load_models",
    "SELECT 'kept' AS model, count(*) AS n, count(*) AS n_equal, 0::BIGINT AS n_null FROM documents JOIN labels USING (doc_id)",
)
def save_load_models(spark, folder):
    """A fitted model is saved with its predictions, read back, and scores every row as before."""
    d = documents(spark, folder)
    model = ml.fit_model(d, TEXT, "forest", {"numTrees": 5, "maxDepth": 3, "seed": 7})
    scored = ml.score_rows(model, d).select(F.lit("kept").alias("model"), F.lit("uncalib").alias("variant"), "row_id", "p")
    path = bundle.scratch_folder(spark)
    bundle.save_results(scored, {"kept": model}, path)
    before, models = bundle.load_results(spark, path, ["kept"])
    again = ml.score_rows(models["kept"], d).select("row_id", F.col("p").alias("again"))
    return before.join(again, "row_id").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").eqNullSafe(F.col("again"))).alias("n_equal"), F.count_if(F.col("again").isNull()).alias("n_null")
    )

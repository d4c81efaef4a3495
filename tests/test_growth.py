"""What is shuffled, and how often: plans of steps that large tables go through."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortry.functions import ordering, packed
from cohortry.functions.hashing import hash_key
from cohortry.operators import calibration, clusters, interpret, metrics, models, relief, risk, scorers, select, splits
from cohortry.plans import model_queries, split_queries
from cohortry.plans.views import V

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_channels_are_combined_before_the_shuffle(spark):
    channels = [f"c{i}" for i in range(4)]
    value = F.col("id").cast("double")
    signal = spark.range(80).select(F.lit("r").alias("recording"), (F.col("id") % 20).alias("t_idx"), F.expr("concat('c', id div 20)").alias("channel"), value.alias("value"))
    maps = clusters.sensor_maps(signal, channels)
    assert not any("pivotfirst" in line for line in plan(maps))
    assert {r.rid: list(r.x) for r in maps.collect()} == {t: [-30.0, -10.0, 10.0, 30.0] for t in range(20)}


def test_stored_chunks_are_not_shuffled_again(spark):
    maps = spark.range(4000).select((F.col("id") % 40).alias("recording"), F.col("id").alias("rid"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    stored, chunks = clusters._chunked(maps, 50)
    stored = stored.persist()
    assert stored.agg(F.sum("rows")).first()[0] == 4000
    scatter = clusters._scatter(stored, chunks, clusters._start(maps, [2], 1, 0))
    assert scatter.groupBy("recording").agg(F.sum("n").alias("n")).where("n <> 100").isEmpty()
    lines = plan(scatter)
    scan = next(i for i, line in enumerate(lines) if "InMemoryTableScan" in line)
    above = next(i for i in range(scan, 0, -1) if "Join" in lines[i])
    assert not any("Exchange" in line for line in lines[above:scan])
    stored.unpersist()


def test_ranks_join_without_the_row_id(spark):
    d = spark.range(90).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), F.sin("id").alias("b"))
    ranked = select.average_ranks(d, ["a", "b"])
    assert not any("Exchange" in line and "row_id" in line for line in plan(ranked))
    want = d.toPandas().set_index("row_id")[["a", "b"]].rank()
    assert ranked.toPandas().set_index("row_id").loc[want.index].equals(want)


def test_ranks_of_repeated_rows_and_gaps(spark):
    d = spark.createDataFrame([("r", 1.0, None), ("r", 1.0, None), ("s", 2.0, 5.0), ("t", None, None)], "row_id string, a double, b double")
    assert sorted(map(tuple, select.average_ranks(d, ["a", "b"]).collect()), key=str) == [("r", 1.5, None), ("r", 1.5, None), ("s", 3.0, 1.0)]


def test_offsets_are_stored(spark):
    d = spark.range(100).select(F.lit("g").alias("g"), (F.col("id") % 4).alias("b"))
    assert ordering._offsets(d.withColumn("n", F.lit(1)), ["g"], "b", ["n"]).storageLevel.useMemory


def test_digests_are_not_shuffled(spark):
    d = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"))
    folds = splits.stratified_folds(d, 5, ["y"], hash_key("outer", F.col("row_id")), "fold")
    lines = plan(folds)
    first = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("md5" in line for line in lines[:first]) and not any("md5" in line for line in lines[first:])
    by_hash = d.toPandas()
    by_hash["h"] = [hashlib.md5(f"outer:{r}".encode()).hexdigest() for r in by_hash["row_id"]]
    want = by_hash.sort_values("h").groupby("y").cumcount() % 5 + 1
    got = folds.toPandas().set_index("row_id")["fold"]
    assert (got.sort_index() == want.sort_index()).all()


def test_row_plan_needs_no_join(spark):
    assert not any("Join" in line for line in plan(split_queries.row_plan(spark, SF)))


def test_binning_does_not_join_by_feature(spark):
    d = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    binned = scorers.equal_width_bins(d, ["a"])
    assert not any("Join" in line for line in plan(binned))
    assert {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()} == dict.fromkeys(range(10), 6)


def test_folds_are_drawn_once_an_order(spark):
    lines = plan(V(spark, SF).predictions())
    cells = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert not any("md5" in line for line in lines[:cells]) and any("md5" in line for line in lines[cells:])


def test_scores_are_shuffled_packed(spark):
    d = spark.range(4000).select((F.col("id") % 3).cast("int").alias("cell"), F.round(F.sin("id"), 2).alias("p"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    d = d.unionByName(spark.createDataFrame([(0, 0.0, 1), (0, -0.0, 0), (1, None, 1), (2, float("nan"), 0), (3, 0.5, 1)], "cell int, p double, y int"))
    found = packed.packed_auroc(d, [-0.5, 0.0, 0.2])
    assert not any("Exchange hashpartitioning" in line and "p#" in line and "packed" not in line for line in plan(found))
    want = {r["cell"]: r["auroc"] for r in metrics.ranking_metrics(d, ["cell"]).collect()}
    got = {r["cell"]: r["auroc"] for r in found.collect()}
    assert set(got) == set(want) == {0, 1, 2, 3} and got[3] is None
    assert all(abs(got[c] - want[c]) < 1e-12 for c in (0, 1, 2))


def test_importance_in_ranges(spark, monkeypatch):
    d = spark.range(900).select(F.col("id").cast("string").alias("row_id"), F.sin("id").alias("a"), F.cos("id").alias("b"), (F.sin("id") > 0.3).cast("int").alias("y"))
    score = lambda x: x.withColumn("p", F.round(F.col("a") + F.col("b") / 5, 3))
    want = sorted(interpret.perm_importance(d, score, ["a", "b"], 2).collect())
    monkeypatch.setattr(interpret, "RANGE_ROWS", 100)
    monkeypatch.setattr(interpret, "EDGE_ROWS", 50)
    spark.catalog.clearCache()
    assert len(interpret._score_edges(interpret.numbered(d), score, ["a"], 0)) > 3
    assert sorted(interpret.perm_importance(d, score, ["a", "b"], 2).collect()) == want and len(want) == 4
    copies = score(interpret.shuffled_copies(d, ["a", "b"], [0, 1]))
    whole = metrics.ranking_metrics(score(d).withColumn("k", F.lit(1)), ["k"]).first()["auroc"]
    by_windows = {(r["feature"], r["repeat"]): whole - r["auroc"] for r in metrics.ranking_metrics(copies, ["feature", "repeat"]).collect()}
    assert all(abs(by_windows[r["feature"], r["repeat"]] - r["importance"]) < 1e-12 for r in want)


def test_a_plan_with_columns_needs_no_join(spark):
    d = spark.range(120).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"), F.sin("id").alias("a"), F.lit(2.0).alias("b"), (F.sin("id") * 3).alias("c"))
    slim, whole = model_queries.fold_plan(d), model_queries.fold_plan(d, ["a", "b", "c"])
    rows = models._train_rows(d, whole, ["a", "b", "c"], "row_id")
    assert not any("Join" in line for line in plan(rows))
    assert sorted(rows.collect()) == sorted(models._train_rows(d, slim, ["a", "b", "c"], "row_id").collect())
    for p in (slim, whole):
        assert models.fold_feature_select(d, p, ["a", "b", "c"]) == {(0, f): ["a"] for f in (1, 2, 3)}


def test_constants_of_a_fold_are_extremes(spark):
    rows = [(0, 1.0, None, float("nan"), None), (0, 1.0, 2.0, float("nan"), None), (1, 1.0, 2.0, 3.0, None), (1, 4.0, 2.0, float("nan"), None)]
    d = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    found = models._constant_columns(d, list("abcd"), 1.0, ["k"])
    assert not any("hashpartitioning(k" in line and "value" in line for line in plan(found))
    want = select.constant_share(d, list("abcd"), "ignore", ["k"]).where("top_share >= 1").select("k", "feature")
    assert sorted(found.collect()) == sorted(want.collect()) == [(0, "a"), (0, "b"), (0, "c"), (1, "b")]


def test_samples_are_drawn_once_and_without_digests(spark, monkeypatch):
    d = spark.range(400).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 20).alias("group_id"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    lines = plan(select.bootstrap_rows(d, 2))
    assert not any("Exchange" in line and "__h" in line for line in lines)
    drawn = []
    monkeypatch.setattr(select, "cut_lineage", lambda x: drawn.append(x) or x)
    assert select.grouped_pairs(d, ["a", "b"], 2).count() == 1 and len(drawn) == 1


def test_predictions_of_a_patient_are_not_shuffled(spark):
    for together, keys in (("group_id", ["model", "trial", "group_id"]), ("idx", ["model", "variant", "idx"])):
        pooled = V(spark, SF).predictions(together).groupBy(*keys).agg(F.median("p"))
        lines = plan(pooled)
        rows = next(i for i, line in enumerate(lines) if "Generate" in line)
        assert not any("Exchange" in line for line in lines[:rows]) and any("Exchange" in line for line in lines[rows:])
        assert V(spark, SF).predictions(together).exceptAll(V(spark, SF).predictions()).isEmpty()
        assert V(spark, SF).predictions().exceptAll(V(spark, SF).predictions(together)).isEmpty()


def test_many_groups_are_counted_in_cells_first(spark, monkeypatch):
    d = spark.range(500).select(F.when(F.col("id") < 60, F.lit(None)).when(F.col("id") < 150, 7).otherwise(F.col("id")).alias("k"))
    monkeypatch.setattr(ordering, "CELLS", 3)
    for limit in (50, 80, 1000):
        plain, cells = ordering.hot_groups(d, ["k"], limit), ordering.hot_groups(d, ["k"], limit, many=True)
        assert (plain is None) == (cells is None) == (limit == 1000)
        if plain is not None:
            assert sorted(plain.collect(), key=str) == sorted(cells.collect(), key=str)
    counted = []
    monkeypatch.setattr(ordering, "CELLS", 64)
    kind = type(d)
    group = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *by: counted.append(by) or group(self, *by))
    assert ordering.hot_groups(d, ["k"], 300, many=True) is None and len(counted) == 1


def test_patients_are_pooled_once_to_be_ranked(spark):
    d = spark.range(60).select(F.lit("m").alias("model"), F.lit("v").alias("variant"), F.lit("A").alias("group_label"), F.col("id").alias("group_id"), F.sin("id").alias("p"), F.lit(0.1).alias("p_total_std"))
    ranked = risk.ranked_patients(d, "p")
    assert any("InMemoryTableScan" in line for line in plan(ranked))
    assert [r["group_id"] for r in ranked.orderBy("rank_index").collect()] == [r["group_id"] for r in d.orderBy(F.desc("p")).collect()]


def test_samples_move_once_and_runs_stay_where_their_recording_lies(spark):
    samples = V(spark, SF).samples()
    maps = clusters.instant_maps(samples, ["quantity", "price", "discount", "tax"])
    centres = maps.select("recording").distinct().select("recording", F.posexplode(F.array(F.array(*map(F.lit, [0.5, -0.5, 0.5, -0.5])), F.array(*map(F.lit, [0.5, 0.5, -0.5, -0.5])))).alias("cluster", "c"))
    moved = [line for line in plan(clusters.assign_states(maps, centres, 64, 3)) if "Exchange" in line]
    assert not any(c in line for line in moved for c in ("epoch_id", "t_idx", "rid", "__run"))
    order = V(spark, SF).matrix().toPandas().sort_values(["group_id", "shipday", "row_id"])
    got = samples.toPandas().sort_values(["recording", "t_idx"])
    assert got[["quantity", "price", "discount", "tax"]].to_numpy().tolist() == order[["quantity", "price", "discount", "tax"]].to_numpy().tolist()


def test_small_recordings_are_fitted_without_passes(spark):
    maps = spark.range(120).select((F.col("id") % 3).cast("string").alias("recording"), F.col("id").alias("rid"), F.array(F.sin("id"), F.cos(F.col("id") * 7), F.sin(F.col("id") * 3)).alias("x"))
    maps = maps.union(spark.createDataFrame([(None, 1, [1.0, 2.0, 3.0]), ("few", 1, [1.0, 0.0, 0.0]), ("zero", 1, [0.0] * 3), ("zero", 2, [0.0] * 3), ("zero", 3, [0.0] * 3)], maps.schema))
    runs = []
    for rows in (25, 5000):
        begun = spark.range(1).rdd.id()
        table, centres = clusters.fit_k_grid(maps, [2, 3], n_init=3, max_iter=4, chunk_rows=rows)
        runs.append((spark.range(1).rdd.id() - begun, table.orderBy("recording", "k").toPandas(), {(r.recording, r.k, r.cluster): r.c for r in centres.collect()}))
    (many, a, b), (few, c, d) = runs
    assert few * 3 < many and len(c) == 8  # three recordings and "zero" with 2 and 3 states ("few" has one map), none without a name
    assert a.drop(columns=["total_gev"]).astype(str).equals(c.drop(columns=["total_gev"]).astype(str)) and np.allclose(a["total_gev"], c["total_gev"], equal_nan=True)
    assert b.keys() == d.keys() and all(np.allclose(b[k], d[k], atol=1e-9) for k in b)


def test_rows_move_once_to_be_drawn_and_stages_share_a_sample(spark, monkeypatch):
    d = spark.range(400).select(F.col("id").cast("string").alias("row_id"), F.when(F.col("id") > 9, F.col("id") % 20).alias("group_id"), (F.col("id") % 2).cast("int").alias("y"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample = select.bootstrap_rows(d, 3)
        assert not any("Exchange" in line and "__rn" in line for line in plan(sample))
        got = {(r.group_id, r.boot): r.row_id for r in sample.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    digest = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()
    of = {g: sorted((str(i) for i in range(10, 400) if i % 20 == g), key=lambda i: digest("order", i)) for g in range(20)}
    assert got == {(g, b): rows[int(digest(0, b, g)[:8], 16) % len(rows)] for g, rows in of.items() for b in range(3)}
    drawn, was = [], select.bootstrap_rows
    monkeypatch.setattr(select, "bootstrap_rows", lambda *a, **k: drawn.append(a) or was(*a, **k))
    stages = [{"methods": ["fcq"], "n_boot": 2, "top_k": 2}, {"methods": ["fcq", "phik"], "n_boot": 2, "top_k": 1}, {"methods": ["fcq"], "n_boot": 2, "top_k": 1, "seed": 5}]
    kept, tables = select.rank_select(d, ["a", "b"], scorers.SCORERS, stages)
    assert len(kept) == 1 and len(tables) == 3 and [a[1:3] for a in drawn] == [(2, 0), (2, 5)]


def test_nearest_rows_leave_a_task_once(spark):
    d = spark.range(600).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), *[F.round(F.abs(F.sin(F.col("id") * k)), 2).alias(f"x{k}") for k in (3, 7, 11)])
    was = relief.SLICE
    try:
        relief.SLICE = 2000  # a few rows at a time; tasks of a local session are forked with it or not, the result is the same
        closest = relief._Closest(5, 2)
        x = np.random.default_rng(1).integers(0, 6, (40, 5)).astype(float)
        pool = np.random.default_rng(2).random((40, 5)) < 0.7
        rank = np.random.default_rng(3).permutation(40)
        for lo in range(0, 40, 4):
            closest.add(x[lo : lo + 4], pool[lo : lo + 4], rank[lo : lo + 4])
            assert closest.size <= closest.limit
        got = {r: list(zip(a.tolist(), b.tolist())) for r, a, b in closest.each()}
        assert got == {c: sorted((x[i, c], int(rank[i])) for i in range(40) if pool[i, c])[:2] for c in range(5)}
        blocked = relief._blocked(relief._scaled(d, ["x3", "x7", "x11"]), ["x3", "x7", "x11"], [], "row_id", "y", [], 2)
        near = relief._kth_distance(blocked, [], 3)
        assert near.count() == 600
    finally:
        relief.SLICE = was


def test_the_mean_distance_needs_no_pairs(spark):
    rows = [("a", 1.0, 0.5, 0), ("a", 0.0, 0.25, 0), (None, 0.5, 0.5, 0), (None, 0.25, 1.0, 0), ("b", 0.75, 0.0, 0), ("c", 0.75, 0.0, 1), ("d", 0.0, 0.5, 1)]
    d = spark.createDataFrame(rows, "rid string, p double, q double, boot int")
    for keys, groups in (([], [rows]), (["boot"], [[r for r in rows if r[3] == b] for b in (0, 1)])):
        want = [np.mean([abs(r[1] - s[1]) + abs(r[2] - s[2]) for r in g for s in g if r[0] != s[0]]) for g in groups]
        got = relief._mean_distance(d, ["p", "q"], keys)
        assert np.allclose([r.near for r in got.orderBy(*(keys or ["near"])).collect()], want, atol=1e-12)


def test_groups_share_the_draws_of_a_row(spark, monkeypatch):
    rows = [(m, i, None if i == 7 else (i * 37 % 11) / 10, int(i * 13 % 7 < 3)) for m in ("a", "b", None) for i in (*range(40), 3, 3)] + [("c", None, 0.5, 1), ("c", None, 0.25, 0), ("c", 5, 0.5, None)]
    d = spark.createDataFrame(rows, "m string, idx int, p double, y int")
    cells = {}
    for counted in (calibration.COUNTED, 0):
        monkeypatch.setattr(calibration, "COUNTED", counted)
        found = calibration.bootstrap_cells(d, ["m"], range(2, 6), 1)
        assert any("codes" in line for line in plan(found)) == (counted > 0)
        cells[counted] = sorted(map(str, found.select("m", "boot", "p", "n", "pos").collect()))
    assert len({str(v) for v in cells.values()}) == 1 and len(cells[0]) > 40
    monkeypatch.undo()
    tested = V(spark, SF).predictions("idx").where("split = 'test'")
    lines = plan(calibration.bootstrap_cells(tested, ["model", "variant", "split"], range(2), 0, ("trial", "idx")))
    assert not any("Exchange hashpartitioning(trial" in line for line in lines)

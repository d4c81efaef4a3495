"""Large-group paths give the same answers as the small-group paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import ordering
from cohortry.operators import assemble, metrics, risk, select, splits
from cohortry.plans.views import V

from .conftest import SF


@pytest.fixture()
def tiny_limit(monkeypatch):
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 5)


def rows(df, *digits):
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(map(str, map(fix, r))) for r in df.select(*sorted(df.columns)).collect())


def both(monkeypatch, make):
    small = rows(make())
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 5)
    return small, rows(make())


@pytest.mark.parametrize("how", ["median", "nanmedian"])
def test_medians_of_large_groups(spark, monkeypatch, how):
    rows = [(None if i % 11 == 0 else i % 4, float(i * 37 % 101), None if i % 4 == 2 and i % 5 == 0 else float(i % 7)) for i in range(400)]
    d = spark.createDataFrame(rows, "group_id int, a double, b double")
    want = sorted(map(str, assemble.aggregate_groups(d, ["a", "b"], how).collect()))
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 50)
    assert sorted(map(str, assemble.aggregate_groups(d, ["a", "b"], how).collect())) == want and len(want) == 5


@pytest.mark.parametrize("agg", ["mean", "median", "max", "quantile", "softmax"])
def test_patient_risk_of_large_units(spark, monkeypatch, agg):
    p = V(spark, SF).predictions().where("model = 'm1' AND variant = 'uncalib'").persist()
    small, large = both(monkeypatch, lambda: risk.patient_risk(p, agg=agg))
    assert small == large and len(small) > 10


def test_metrics_of_large_folds(spark, monkeypatch):
    p = V(spark, SF).predictions().where("model = 'm2' AND variant = 'uncalib'").persist()
    small, large = both(monkeypatch, lambda: metrics.ranking_metrics(p))
    assert small == large


def test_row_index_of_large_groups(spark, monkeypatch):
    d = V(spark, SF).matrix().select("row_id", "group_id", "y")
    small, large = both(monkeypatch, lambda: splits.strat_kfold(d, 5, 2))
    assert small == large


def test_grouped_quantiles(spark, monkeypatch):
    d = V(spark, SF).matrix()
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.93, "e": 1.0}
    small, large = both(monkeypatch, lambda: ordering.grouped_quantiles(d, ["group_id"], "price", qs))
    assert small == large


def test_column_quantiles_match_numpy(spark):
    d = V(spark, SF).missing()
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = ordering.column_quantiles(d, ["price", "tax", "discount"], qs, accuracy=200)
    table = d.select("price", "tax", "discount").toPandas()
    for c, values in got.items():
        np.testing.assert_allclose(values, np.nanquantile(table[c].astype(float), qs), rtol=1e-12)


def test_column_quantiles_of_an_empty_column(spark):
    d = spark.range(5).select(F.lit(None).cast("double").alias("x"))
    assert ordering.column_quantiles(d, ["x"], [0.5]) == {"x": [None]}


def test_value_runs_with_one_dominant_value(spark, tiny_limit):
    d = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).cast("double").alias("v"))
    runs = ordering.value_runs(d.withColumn("k", F.lit(1)), ["k"], "v").orderBy("v").collect()
    assert runs[0]["v"] == 0.0 and runs[0]["n"] == 1000
    before = 0
    for r in runs:
        assert r["before_n"] == before and r["total_n"] == 3000
        before += r["n"]


def test_null_groups_survive_every_size(spark, monkeypatch):
    d = spark.createDataFrame([(None if i % 2 else "k", float(i % 4) if i % 3 else None, i) for i in range(24)], "k string, v double, i int")
    number = lambda: ordering.row_index(d, ["k"], ["v", "i"], lambda x: ordering.with_range_bucket(x, "v"), total="n")
    small, large = both(monkeypatch, number)
    assert small == large and len(small) == 24
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 1_000_000)
    runs = lambda: ordering.value_runs(d, ["k"], "v").drop(ordering.BUCKET)
    small = rows(runs())
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 2)
    assert small == rows(runs()) and any("None" in r for r in small)
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 1_000_000)
    ends = lambda: ordering.grouped_quantiles(d, ["k"], "v", {"q": 0.5})
    small = rows(ends())
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 5)
    assert small == rows(ends()) and len(small) == 2


def test_text_order_by_buckets_equals_one_window(spark, monkeypatch):
    rows = [(f"folder {i % 3}" if i % 7 else None, f"https://one.example/shared/beginning/{i * 37 % 101:03d}.edf") for i in range(101)]
    paths = spark.createDataFrame(rows, "folder string, path string")
    groups = spark.createDataFrame([(str(i % 2), f"S1-{i:04d}") for i in range(60)], "label string, subject_id string")

    def all_three():
        a = assemble.folder_index(paths, F.col("folder"))
        b = assemble.group_dimension(groups)
        c = assemble.label_map(paths.select(F.col("path").alias("label")))
        return [sorted(map(tuple, d.collect())) for d in (a, b, c)]

    whole = all_three()
    assert [len(x) for x in whole] == [86, 60, 101]
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 2)
    assert all_three() == whole
    monkeypatch.setattr(ordering, "EDGE_SAMPLE", 3)
    assert all_three() == whole


def test_subject_merge_keeps_the_left_rows(spark):
    left = spark.createDataFrame([(" a", 1), ("b ", 2), (None, 3), (None, 4)], "sid string, ord int")
    right = spark.createDataFrame([("a", 9, 0.5), ("a ", 8, 0.25), (None, 7, 0.1)], "sid string, ord int, v double")
    got = sorted(map(tuple, assemble.subject_merge(left, right, "sid", "ord").collect()), key=lambda r: r[1])
    assert got == [("a", 1, 0.25), ("b", 2, None), (None, 3, None), (None, 4, None)]
    with pytest.raises(ValueError):
        assemble.subject_merge(right, left, "sid", "ord")


def test_gaps_and_constants(spark):
    ids = spark.createDataFrame([(0,), (3,), (None,)], "group_id long")
    assert sorted(r[0] for r in assemble.group_gaps(ids).collect()) == [1, 2]
    assert assemble.group_gaps(ids.limit(0)).count() == 0
    d = spark.createDataFrame([(1.0, None, 2.0), (1.0, None, 3.0), (None, None, 2.0)], "a double, b double, c double")
    assert [tuple(r) for r in select.constant_features(d, ["a", "b", "c"], missing="ignore").collect()] == [("a", 1.0, 2)]
    with pytest.raises(Exception, match="missing values"):
        select.constant_features(d, ["a"]).collect()

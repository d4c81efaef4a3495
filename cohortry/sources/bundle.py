"""Saving and loading tables, split plans, features and results as Parquet."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.operators.splits import split_manifest
from cohortry.table import FeatureTable


def scratch_folder(spark: SparkSession) -> str:
    """A folder all executors share; a private one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/cohortry-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def save_table(table: FeatureTable, path: str) -> None:
    """The rows, the dimensions given, and a manifest with the feature order."""
    table.df.write.mode("overwrite").parquet(f"{path}/rows")
    parts = ["rows"]
    for name in ("groups", "labels"):
        part = getattr(table, name)
        if part is not None:
            part.write.mode("overwrite").parquet(f"{path}/{name}")
            parts.append(name)
    manifest = [(list(table.features), table.row, table.group, table.y, parts)]
    schema = "features array<string>, row string, group string, y string, parts array<string>"
    table.df.sparkSession.createDataFrame(manifest, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_table(spark: SparkSession, path: str, require: Sequence[str] = ("rows",)) -> FeatureTable:
    m = spark.read.parquet(f"{path}/manifest").first()
    if missing := set(require) - set(m["parts"]):
        raise FileNotFoundError(f"{path} lacks {sorted(missing)}")
    read = lambda n: spark.read.parquet(f"{path}/{n}") if n in m["parts"] else None
    return FeatureTable(read("rows"), tuple(m["features"]), m["row"], m["group"], m["y"], read("groups"), read("labels"))


def save_features(features: DataFrame, path: str, label: str = "label") -> None:
    """Per-subject feature rows, one folder per label."""
    features.write.mode("overwrite").partitionBy(label).parquet(path)


def load_features(spark: SparkSession, path: str, labels: Sequence[str] | None = None, label: str = "label") -> DataFrame:
    """Only the folders of the wanted labels are read."""
    d = spark.read.parquet(path)
    return d if labels is None else d.where(F.col(label).isin(list(labels)))


def save_splits(splits: DataFrame, path: str, content: str = "full") -> None:
    """``full`` keeps group and label; ``plan_only`` just the assignment."""
    if content not in ("full", "plan_only"):
        raise ValueError(f"unknown content {content!r}")
    plan = ["trial", "outer_fold", "inner_fold", "row_id", "role"]
    d = splits if content == "full" else splits.select(*plan)
    d.write.mode("overwrite").partitionBy("trial").parquet(f"{path}/splits")
    split_manifest(splits).write.mode("overwrite").parquet(f"{path}/manifest")


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/splits"), spark.read.parquet(f"{path}/manifest")


def save_results(predictions: DataFrame, models: Mapping[str, PipelineModel], path: str) -> None:
    """Predictions by model and variant, and the fitted models."""
    predictions.write.mode("overwrite").partitionBy("model", "variant").parquet(f"{path}/predictions")
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")


def load_results(spark: SparkSession, path: str, models: Sequence[str] = ()) -> tuple[DataFrame, dict[str, PipelineModel]]:
    return spark.read.parquet(f"{path}/predictions"), {m: PipelineModel.load(f"{path}/models/{m}") for m in models}

"""Fitting and tuning models on split plans: logistic regressions all together, other MLlib estimators one by one."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortry.functions.hashing import hash_bucket, hash_key
from cohortry.functions.ordering import row_index
from cohortry.operators import batched
from cohortry.operators.metrics import ranking_metrics
from cohortry.operators.select import column_means, constant_share, correlation_pairs, correlation_states, greedy_prune, has_gap, pearson_pairs, vif_history
from cohortry.session import cut_lineage

ESTIMATORS: dict[str, Callable[..., object]] = {
    "logistic": LogisticRegression,
    "forest": RandomForestClassifier,
    "gbt": GBTClassifier,
}


def fit_model(train: DataFrame, features: Sequence[str], estimator: str | Callable[..., object], params: Mapping | None = None, y: str = "y") -> PipelineModel:
    """Assemble and fit on rows without missing values."""
    cls = ESTIMATORS[estimator] if isinstance(estimator, str) else estimator
    est = cls(featuresCol="__features", labelCol="__label", **(params or {}))
    stages = [VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep"), est]
    d = train.dropna(subset=[*features, y]).withColumn("__label", F.col(y).cast("double"))
    return Pipeline(stages=stages).fit(d.select(*features, "__label"))


def score_rows(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the probability of class 1; a row with a missing feature keeps its place with a null."""
    p = vector_to_array(F.col("probability"))[1]
    whole = ~has_gap(model.stages[0].getInputCols())
    return model.transform(df).withColumn(out, F.when(whole, p)).select(*df.columns, out)


def fit_score(train: DataFrame, test: DataFrame, features: Sequence[str], estimator, params: Mapping | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit and return the model with AUROC and average precision on both sides."""
    model = fit_model(train, features, estimator, params)
    both = None
    for split, d in (("train", train), ("test", test)):
        scored = score_rows(model, d).select(F.lit(split).alias("split"), "y", "p")
        both = scored if both is None else both.unionByName(scored)
    return model, ranking_metrics(both, ["split"])


def param_grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def sampled_params(space: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """``n`` distinct settings of the grid in an order fixed by the seed."""
    import hashlib

    grid = param_grid(space)
    return sorted(grid, key=lambda g: hashlib.md5(f"{seed}:{sorted(g.items())}".encode()).hexdigest())[:n]


def is_batched(estimator, params: Sequence[Mapping]) -> bool:
    """Can all settings be fitted together (ridge-penalised logistic regression)?"""
    return estimator == "logistic" and all(set(p) <= {"regParam", "maxIter"} for p in params)


def inner_cv_scores(
    train: DataFrame, features: Sequence[str], estimator, params: Sequence[Mapping], inner: str = "inner_fold", metric: str = "auprc", row: str = "row_id"
) -> list[dict]:
    """Train and held-out score of every setting on every inner fold.

    Logistic regressions are all fitted together; other estimators one after another.
    """
    if is_batched(estimator, params):
        plan = train.select(F.lit(0).alias("trial"), F.lit(0).alias("outer_fold"), F.col(inner).alias("inner_fold"), row, F.lit("outer_train").alias("role"))
        return tuning_scores(train, plan, {(0, 0): features}, params, metric, row)[0, 0]
    folds = sorted(r[0] for r in train.select(inner).distinct().collect())
    out = []
    for i, setting in enumerate(params):
        for fold in folds:
            fit, held = train.where(F.col(inner) != fold), train.where(F.col(inner) == fold)
            _, scores = fit_score(fit, held, features, estimator, setting)
            by = {r["split"]: r[metric] for r in scores.collect()}
            out.append({"setting": i, "inner_fold": fold, "train": by.get("train"), "test": by.get("test")})
    return out


def tuning_scores(
    df: DataFrame, plan: DataFrame, features: Mapping[tuple[int, int], Sequence[str]], params: Sequence[Mapping], metric: str = "auprc", row: str = "row_id"
) -> dict[tuple[int, int], list[dict]]:
    """Inner scores of every setting in every (trial, outer_fold), from one batched fit of all of them.

    A row is held once, with the list of the cells that train on it and of those that are
    tested on it; each fold may use its own features.
    """
    names = sorted({c for chosen in features.values() for c in chosen})
    outer = {cell: k for k, cell in enumerate(sorted(features))}
    train = plan.where("role = 'outer_train'")
    inner = sorted(r[0] for r in train.select("inner_fold").distinct().collect())
    n_set, n_in = len(params), len(inner)
    number = lambda k, s, g: (k * n_set + s) * n_in + g
    spark = df.sparkSession
    tags = spark.createDataFrame([(t, f, k) for (t, f), k in outer.items()], "trial int, outer_fold int, k int")
    held = spark.createDataFrame([(g, i) for i, g in enumerate(inner)], "inner_fold int, g int")
    placed = train.join(F.broadcast(tags), ["trial", "outer_fold"]).join(F.broadcast(held), "inner_fold")
    settings = F.sequence(F.lit(0), F.lit(n_set - 1))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_in - 1)), lambda g: g != F.col("g"))
    fit = F.flatten(F.transform(settings, lambda s: F.transform(others, lambda g: number(F.col("k"), s, g))))
    test = F.transform(settings, lambda s: number(F.col("k"), s, F.col("g")))
    lists = placed.groupBy(row).agg(F.flatten(F.collect_list(fit)).alias("fit_cells"), F.flatten(F.collect_list(test)).alias("test_cells"))
    rows = df.select(row, "y", *names).join(lists, row).persist()
    cells = [
        batched.Cell(float(p.get("regParam", 0.0)), [names.index(c) for c in features[cell]], int(p.get("maxIter", batched.STEPS)))
        for cell in outer for p in params for _ in inner
    ]
    fits = batched.fit_cells(rows, names, cells, cell_column="fit_cells")
    both = None
    for split, column in (("train", "fit_cells"), ("test", "test_cells")):
        d = batched.score_cells(rows.select("y", *names, F.col(column).alias("cells")), names, fits).select(F.lit(split).alias("split"), "cell", "y", "p")
        both = d if both is None else both.unionByName(d)
    found = {(r["cell"], r["split"]): r[metric] for r in ranking_metrics(both, ["cell", "split"]).collect()}  # two numbers a cell
    rows.unpersist()
    at = lambda k, s, g, split: found.get((number(k, s, g), split))
    return {
        cell: [
            {"setting": s, "inner_fold": fold, "train": at(k, s, g, "train"), "test": at(k, s, g, "test")}
            for s in range(n_set) for g, fold in enumerate(inner)
        ]
        for cell, k in outer.items()
    }


def best_setting(scores: Sequence[Mapping]) -> int:
    """Setting with the highest mean held-out score; ties to the earlier one."""
    by: dict[int, list[float]] = {}
    for s in scores:
        by.setdefault(s["setting"], []).append(s["test"] if s["test"] is not None else float("-inf"))
    return max(by, key=lambda k: (sum(by[k]) / len(by[k]), -k))


def nested_cv(
    df: DataFrame,
    plan: DataFrame,
    features: Sequence[str] | Mapping[tuple[int, int], Sequence[str]],
    estimator,
    space: Mapping[str, Sequence],
    name: str,
    row: str = "row_id",
    metric: str = "auprc",
    max_features: int | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, dict]:
    """Tune on inner folds, refit on outer-train, score train and test of every fold.

    ``features`` is one list, or a list per (trial, outer_fold) from the selection
    step.  Returns long predictions and the chosen settings.
    """
    cells = [tuple(r) for r in plan.select("trial", "outer_fold").distinct().orderBy("trial", "outer_fold").collect()]
    chosen = {cell: list(features[cell] if isinstance(features, Mapping) else features)[:max_features] for cell in cells}
    joined = df.join(plan.select("trial", "outer_fold", "inner_fold", row, "role"), row).persist()
    grid = param_grid(space)
    together = tuning_scores(df, plan, chosen, grid, metric, row) if len(grid) > 1 and is_batched(estimator, grid) else None

    def one(cell: tuple[int, int]):
        names = chosen[cell]
        part = joined.where((F.col("trial") == cell[0]) & (F.col("outer_fold") == cell[1]))
        train = part.where("role = 'outer_train'")
        best = 0
        if len(grid) > 1:
            best = best_setting(together[cell] if together else inner_cv_scores(train, names, estimator, grid, metric=metric, row=row))
        model = fit_model(train, names, estimator, grid[best])
        scored = score_rows(model, part).select(
            F.lit(name).alias("model"), F.lit("uncalib").alias("variant"),
            F.when(F.col("role") == "outer_test", "test").otherwise("train").alias("split"),
            "trial", "outer_fold", F.col(row).alias("idx"), "group_id", "y", "p",
        )
        return cell, grid[best], scored, model

    with ThreadPool(parallelism) as pool:
        results = pool.map(one, cells)
    joined.unpersist()
    out = results[0][2]
    for r in results[1:]:
        out = out.unionByName(r[2])
    return out, {cell: {"params": params, "model": model} for cell, params, _, model in results}


def oof_predictions(train: DataFrame, features: Sequence[str], estimator, params: Mapping | None = None, k: int = 5, row: str = "row_id", y: str = "y") -> DataFrame:
    """Score every training row with a fresh model that did not see its fold; null where a feature is missing.

    The models of logistic regressions are fitted together.
    """
    d = train.withColumn("__h", hash_key("oof", F.col(row)))
    d = row_index(d, [y], ["__h"], hash_bucket(F.col("__h")), "__i")
    d = d.withColumn("oof_fold", (1 + F.col("__i") % k).cast("int")).drop("__h", "__i").persist()
    if is_batched(estimator, [params or {}]):
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: c != F.col("oof_fold") - 1)
        cell = batched.Cell(float((params or {}).get("regParam", 0.0)), None, int((params or {}).get("maxIter", batched.STEPS)))
        fits = batched.fit_cells(d.withColumn("__cells", others), features, [cell] * k, y, "__cells")
        held = d.withColumn("__cells", F.array(F.col("oof_fold") - 1))
        return batched.score_cells(held, features, fits, "__cells", "__cell").select(*d.columns, "p")
    out = None
    for fold in range(1, k + 1):
        model = fit_model(d.where(F.col("oof_fold") != fold), features, estimator, params, y)
        part = score_rows(model, d.where(F.col("oof_fold") == fold))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------- selection inside the folds


def _train_rows(df: DataFrame, plan: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """Outer-train rows with the columns; a plan that carries them all needs no join."""
    if set(columns) <= set(plan.columns):
        return plan.where("role = 'outer_train'").select(row, *columns, "trial", "outer_fold")
    train = plan.where("role = 'outer_train'").select("trial", "outer_fold", row)
    return df.select(row, *columns).join(train, row)


def _constant_columns(d: DataFrame, columns: Sequence[str], tol: float, keys: Sequence[str]) -> DataFrame:
    """(keys, feature) whose most frequent value has a share of at least ``tol``; a share of one takes two extremes."""
    if tol < 1.0:
        return constant_share(d, columns, "ignore", keys).where(F.col("top_share") >= tol).select(*keys, "feature")
    if tol > 1.0:
        return d.select(*keys, F.lit("").alias("feature")).limit(0)
    ends = [F.struct(F.lit(c).alias("feature"), (F.min(c) == F.max(c)).alias("same")) for c in columns]
    return d.groupBy(*keys).agg(F.array(*ends).alias("ends")).select(*keys, F.inline("ends")).where("same").drop("same")


def fold_feature_select(
    df: DataFrame, plan: DataFrame, columns: Sequence[str], tol: float = 1.0, threshold: float = 0.8, method: str = "pearson", row: str = "row_id"
) -> dict[tuple[int, int], list[str]]:
    """Constant and collinearity pruning on the outer-train rows of every fold.

    The fold is one more grouping key, so all folds are measured together.  Folds, constants and
    close pairs come back in one table, so the rows of the plan move once for all of them.
    """
    fold = ["trial", "outer_fold"]
    d = _train_rows(df, plan, columns, row)
    names = [F.lit(None).cast("string").alias("feature_b"), F.lit(None).cast("double").alias("r")]
    cells = plan.groupBy(*fold).agg(F.lit(None).cast("string").alias("feature_a")).select(*fold, "feature_a", *names)
    flat = _constant_columns(d, columns, tol, fold).select(*fold, F.col("feature").alias("feature_a"), *names)
    # centres only keep sums small: those of the whole table serve all folds
    pairs = pearson_pairs(d, columns, fold, column_means(df, columns)) if method == "pearson" else correlation_pairs(d, columns, method, row, fold)
    close = pairs.where(F.abs("r") >= threshold).select(*fold, "feature_a", "feature_b", "r")
    found: dict[tuple, tuple[set, list]] = {}
    for r in cells.unionByName(flat).unionByName(close).collect():
        constant, near = found.setdefault((r["trial"], r["outer_fold"]), (set(), []))
        if r["feature_b"] is not None:
            near.append((r["feature_a"], r["feature_b"], r["r"]))
        elif r["feature_a"] is not None:
            constant.add(r["feature_a"])
    spark, schema = df.sparkSession, "feature_a string, feature_b string, r double"
    out = {}
    for cell in sorted(found):
        constant, near = found[cell]
        left = [c for c in columns if c not in constant]
        rows = [r for r in near if r[0] in left and r[1] in left]
        out[cell] = greedy_prune(spark.createDataFrame(rows, schema), left, threshold)[0] if rows else left
    return out


def fold_vif(
    df: DataFrame, plan: DataFrame, columns: Sequence[str], thresholds: Sequence[float] = (5.0,), cap: float = 1e6, row: str = "row_id"
) -> DataFrame:
    """VIF elimination per fold; one history row per threshold, fold and step."""
    fold = ["trial", "outer_fold"]
    states = cut_lineage(correlation_states(_train_rows(df, plan, columns, row), columns, fold, column_means(df, columns)))
    out = None
    for limit in thresholds:
        one = vif_history(states, columns, limit, cap).select(F.lit(float(limit)).alias("threshold"), *fold, "step", "removed", "vif")
        out = one if out is None else out.unionByName(one)
    return out


def features_table(spark, chosen: Mapping[tuple[int, int], Sequence[str]]) -> DataFrame:
    """(trial, outer_fold, position, feature) of a per-fold selection."""
    rows = [(*cell, i, c) for cell, names in chosen.items() for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "trial int, outer_fold int, position int, feature string")

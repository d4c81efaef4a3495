"""Many penalised logistic regressions at once: every fold, setting and trial is a cell of one fit.

A row carries the list of cells that train on it.  One pass over the rows yields, for all
cells together, the gradient and the Hessian of the loss: each task multiplies its batch of
rows with the coefficients of all cells and adds up the weighted products of features, and
the sums of a cell are added across tasks.  Newton steps on those sums, at most ``MOST``
numbers, are taken on the driver; rows never go there.  A pass costs one scan whatever the
number of cells, and about eight passes settle them all.

The loss is the mean log loss plus ``penalty`` / 2 times the squared coefficients of the
features scaled to unit variance in the cell's training rows; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Numbers that one pass returns at most (cells x squared features).
MOST = 20_000_000
STEPS = 60
TOLERANCE = 1e-9
#: Largest change of the linear predictor, in standard deviations of the features, that one step may make.
LONGEST = 20.0


@dataclass
class Cell:
    """One regression: the penalty and the features it uses (all of them, or places in the list)."""

    penalty: float = 0.0
    features: Sequence[int] | None = None
    steps: int = STEPS


@dataclass
class Fits:
    """Coefficients (cells x (1 + features), in the features' own units), and whether each cell settled."""

    coefficients: np.ndarray
    converged: np.ndarray
    used: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch], centre: np.ndarray, scale: np.ndarray, coefficients: np.ndarray | None, n_cells: int) -> Iterator[pa.RecordBatch]:
    """Per cell: rows, products of features (weighted in a Newton pass) and gradient, over the task's rows."""
    d = len(centre)
    left, right = np.triu_indices(d + 1)
    products, gradient = np.zeros((n_cells, len(left))), np.zeros((n_cells, d + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = (batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - centre) / scale
        x = np.column_stack([np.ones(len(x)), x])
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        cells = batch.column("cells")
        rows = np.repeat(np.arange(len(x)), np.diff(cells.offsets.to_numpy()))
        member = np.zeros((len(x), n_cells))
        member[rows, cells.flatten().to_numpy()] = 1.0
        if coefficients is None:
            weight, off = member, member * y[:, None]
        else:
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ coefficients.T, -500, 500)))
            weight, off = member * p * (1 - p), member * (y[:, None] - p)
        products += weight.T @ (x[:, left] * x[:, right])
        gradient += off.T @ x
    body = [np.concatenate([g, h]).tobytes() for g, h in zip(gradient, products)]
    yield pa.RecordBatch.from_arrays([pa.array(range(n_cells), pa.int32()), pa.array(body, pa.binary())], names=["cell", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal cells in a row, added."""
    cell, total = None, None
    for batch in batches:
        for c, raw in zip(batch.column("cell").to_pylist(), batch.column("sums")):
            sums = np.frombuffer(raw.as_py(), dtype=np.float64)
            if c == cell:
                total = total + sums
                continue
            if cell is not None:
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["cell", "sums"])
            cell, total = c, sums
    if cell is not None:
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["cell", "sums"])


def _pass(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, coefficients: np.ndarray | None, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and symmetric matrices of all cells from one scan."""
    d, schema = len(centre), "cell int, sums binary"
    part = rows.mapInArrow(lambda batches: _sums(batches, centre, scale, coefficients, n_cells), schema)
    total = part.repartition("cell").sortWithinPartitions("cell").mapInArrow(_added, schema)
    gradient, matrix = np.zeros((n_cells, d + 1)), np.zeros((n_cells, d + 1, d + 1))
    left, right = np.triu_indices(d + 1)
    for r in total.collect():
        sums = np.frombuffer(bytes(r["sums"]), dtype=np.float64)
        gradient[r["cell"]] = sums[: d + 1]
        matrix[r["cell"]][left, right] = matrix[r["cell"]][right, left] = sums[d + 1 :]
    return gradient, matrix


def packed(df: DataFrame, features: Sequence[str], y: str = "y", cells: str = "cells") -> DataFrame:
    """Rows with a label, all features and at least one cell, as arrays: x, y, cells."""
    d = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(y).cast("double").alias("y"), F.col(cells).cast("array<int>").alias("cells"))
    return d.where(F.col("y").isNotNull() & (F.size("cells") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def fit_cells(df: DataFrame, features: Sequence[str], cells: Sequence[Cell], y: str = "y", cell_column: str = "cells") -> Fits:
    """Fit every cell on the rows whose ``cell_column`` (an array of cell numbers) names it.

    A cell without rows of both classes has no coefficients (NaN).  Rows with a missing
    feature do not train.  ``converged`` is false where steps ran out, as with separable rows.
    """
    d, n = len(features), len(cells)
    if n * (d + 1) * (d + 2) // 2 > MOST:
        raise ValueError(f"{n} cells of {d} features return more than {MOST} numbers; fit them in parts")
    rows = packed(df, features, y, cell_column).persist()
    try:
        head = rows.select(*[F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_samp(F.col("x")[i]).alias("s")).alias(f"f{i}") for i in range(d)]).first()
        centre = np.array([head[f"f{i}"]["m"] or 0.0 for i in range(d)])
        scale = np.array([head[f"f{i}"]["s"] or 1.0 for i in range(d)])
        positives, moments = _pass(rows, centre, scale, None, n)
        size, pos = moments[:, 0, 0], positives[:, 0]
        able = (pos > 0) & (pos < size)
        # variance of each feature in each cell's rows, for the penalty
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = moments[:, 0, 1:] / size[:, None]
            variance = (np.diagonal(moments, axis1=1, axis2=2)[:, 1:] - size[:, None] * mean**2) / np.maximum(size - 1, 1)[:, None]
        variance = np.nan_to_num(np.maximum(variance, 0.0))
        free = np.zeros((n, d + 1), dtype=bool)
        free[:, 0] = True
        for k, cell in enumerate(cells):
            free[k, 1:][list(range(d) if cell.features is None else cell.features)] = True
        free[:, 1:] &= variance > 1e-24
        ridge = np.column_stack([np.zeros(n), np.array([[c.penalty] for c in cells]) * variance * size[:, None]])
        b, done = np.zeros((n, d + 1)), ~able
        left = np.array([c.steps for c in cells])
        while (todo := ~done & (left > 0)).any():
            gradient, hessian = _pass(rows, centre, scale, b, n)
            for k in np.flatnonzero(todo):
                use = np.flatnonzero(free[k])
                g = (gradient[k] - ridge[k] * b[k])[use]
                h = (hessian[k] + np.diag(ridge[k]))[np.ix_(use, use)]
                step = np.linalg.lstsq(h + 1e-12 * np.trace(h) * np.eye(len(use)), g, rcond=None)[0]
                reach = np.abs(step).max()
                if reach > LONGEST:
                    step *= LONGEST / reach
                b[k][use] += step
                done[k] = reach < TOLERANCE * max(1.0, np.abs(b[k]).max())
            left = left - todo
    finally:
        rows.unpersist()
    out = np.full((n, d + 1), np.nan)
    out[able, 1:] = b[able, 1:] / scale
    out[able, 0] = b[able, 0] - (b[able, 1:] / scale * centre).sum(axis=1)
    return Fits(out, done & able, size)


def score_cells(df: DataFrame, features: Sequence[str], fits: Fits, cells: str = "cells", name: str = "cell", out: str = "p") -> DataFrame:
    """A row for each row and each cell in its array ``cells``: all columns of ``df`` but that one, ``name`` and the probability.

    It is null where a feature is missing or the cell could not be fitted.
    """
    rows = [(k, *[None if np.isnan(v) else float(v) for v in c]) for k, c in enumerate(fits.coefficients)]
    fields = f"{name} int, " + ", ".join(f"__b{i} double" for i in range(len(features) + 1))
    table = df.sparkSession.createDataFrame(rows, fields)
    each = df.select(*[c for c in df.columns if c != cells], F.explode(cells).alias(name))
    eta = sum((F.col(f"__b{i}") * F.col(c).cast("double") for i, c in enumerate(features, 1)), F.col("__b0"))
    # one row a cell, at most MOST numbers in all
    met = each.join(F.broadcast(table), name)
    return met.select(*[c for c in each.columns if c != name], name, (1.0 / (1.0 + F.exp(-eta))).alias(out))

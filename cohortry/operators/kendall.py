"""Kendall's tau-b without comparing all pairs.

Both columns are cut into value ranges.  Concordant minus discordant pairs then
splits into pairs within one x range, pairs within one y range (x ranges differing),
and pairs differing in both ranges.  The first two are sorted counts inside groups of
one range, the third a count over the small table of range by range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortry.functions.ordering import edge_bucket
from cohortry.functions.rows import join_same

RANGE_ROWS = 100_000
MAX_RANGES = 512
PAIR = ["feature_a", "feature_b"]


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j sign(dx) sign(dy) over pairs, in O(m log^2 m)."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype(float)

    def ordered(lo: int, hi: int) -> float:
        if hi - lo < 2:
            return 0.0
        mid = (lo + hi) // 2
        left = np.argsort(y[lo:mid], kind="stable")
        ys, cum = y[lo:mid][left], np.concatenate(([0.0], np.cumsum(w[lo:mid][left])))
        below = cum[np.searchsorted(ys, y[mid:hi], side="left")]
        above = cum[-1] - cum[np.searchsorted(ys, y[mid:hi], side="right")]
        return float((w[mid:hi] * (below - above)).sum()) + ordered(lo, mid) + ordered(mid, hi)

    # Pairs of equal x are in ascending y above and must not count.
    frame = pd.DataFrame({"x": x, "y": y, "w": w})
    per_x = frame.groupby("x")["w"].sum()
    per_xy = frame.groupby(["x", "y"])["w"].sum()
    return ordered(0, len(x)) - ((per_x**2).sum() - (per_xy**2).sum()) / 2


def _edges(df: DataFrame, columns: Sequence[str], n: int) -> dict[str, list[float]]:
    """Quantile edges; a value filling several quantiles gets a range of its own."""
    if n < 2:
        return {c: [] for c in columns}
    probs = [i / n for i in range(1, n)]
    row = df.agg(*[F.percentile_approx(c, probs, max(1000, 4 * n)).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        values = [float(v) for v in row[c] or []]
        heavy = {v for v in values if values.count(v) > 1}
        out[c] = sorted(set(values) | {math.nextafter(v, -math.inf) for v in heavy})
    return out


def _kernel(cells: DataFrame, by: list[str], keys: list[str], x: str, y: str) -> DataFrame:
    """Concordance of the cells of each (by, keys), as a row of ``by`` and s."""
    fields = StructType([*[cells.schema[k] for k in by], StructField("s", DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        s = concordance(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["w"].to_numpy())
        return pdf[by].head(1).assign(s=s)

    return cells.groupBy(*by, *keys).applyInPandas(fn, fields)


def _varying(cells: DataFrame, by: list[str], bucket: str, value: str) -> DataFrame:
    """Cells of the ranges that hold more than one value; the others add nothing."""
    span = cells.groupBy(*by, bucket).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return join_same(cells, span.where("lo < hi").select(*by, bucket), [*by, bucket], "left_semi")


def _ties(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    t = cells.groupBy(*by, value).agg(F.sum("w").cast("double").alias("t"))
    return t.groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"ties_{value}"))


def kendall_pairs(df: DataFrame, columns: Sequence[str], n_ranges: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature_a, feature_b, r): tau-b of every pair over rows with both values, in every group of ``keys``.

    Ranges are those of the whole columns, as many as the largest group needs.
    """
    columns, keys = list(columns), list(keys)
    by = [*keys, *PAIR]
    if n_ranges is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        n_ranges = min(MAX_RANGES, max(1, math.ceil((sizes.agg(F.max("n")).first()[0] or 0) / RANGE_ROWS)))
    edges = _edges(df, columns, n_ranges)
    part = lambda a, b: F.struct(
        F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
        F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"),
        edge_bucket(F.col(a), edges[a]).alias("xb"), edge_bucket(F.col(b), edges[b]).alias("yb"),
    )
    long = df.select(*keys, F.inline(F.array(*[part(a, b) for a, b in combinations(columns, 2)])))
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cells = long.groupBy(*by, "x", "y", "xb", "yb").agg(F.count(F.lit(1)).alias("w")).persist()
    table = cells.groupBy(*by, "xb", "yb").agg(F.sum("w").alias("w"))
    s = _kernel(_varying(cells, by, "xb", "x"), by, ["xb"], "x", "y")
    if n_ranges > 1:  # with one range each, every pair of rows lies within it
        s = s.unionByName(_kernel(_varying(cells, by, "yb", "y"), by, ["yb"], "xb", "y")).unionByName(_kernel(table, by, [], "xb", "yb"))
    d = cells.groupBy(*by).agg(F.sum("w").cast("double").alias("n"))
    for other in (s.groupBy(*by).agg(F.sum("s").alias("s")), _ties(cells, by, "x"), _ties(cells, by, "y")):
        d = join_same(d, other, by, "left")
    total = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt((total - F.col("ties_x")) * (total - F.col("ties_y"))))
    return d.select(*by, F.coalesce(tau, F.lit(0.0)).alias("r"))

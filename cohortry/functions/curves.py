"""Curves on a shared grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.ordering import edge_bucket


def interp_grid(
    curve: DataFrame, keys: Sequence[str], x: str, y: str, grid: Sequence[float], tie: str | None = None
) -> DataFrame:
    """Linear interpolation of every curve at the grid points, clamped at the ends.

    Points fall into the intervals between grid points, and each interval keeps its
    first and last point (combined on the map side), so a curve is held as one list
    no longer than the grid, however many points it has.  Among points of equal x the
    last one under ``tie`` counts.  Columns: keys, grid_index, grid, value.
    """
    keys, grid = list(keys), [float(g) for g in grid]
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    order = F.struct(F.col(x), F.col(tie)) if tie else F.struct(F.col(x))
    cells = (
        curve.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .withColumn("grid_index", edge_bucket(F.col(x), grid))
        .groupBy(*keys, "grid_index")
        .agg(F.max_by(point, order).alias("last"), F.min_by(point, order).alias("first"))
    )
    n = len(grid)
    # At most n + 1 cells per curve.
    d = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("grid_index", "last", "first"))).alias("__cells"))
    d = d.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    upto = F.filter("__cells", lambda c: c["grid_index"] <= F.col("grid_index"))
    after = F.filter("__cells", lambda c: c["grid_index"] > F.col("grid_index"))
    g = F.get(F.array(*[F.lit(v) for v in grid]), F.col("grid_index"))
    d = d.select(
        *keys, "grid_index", g.alias("grid"), F.try_element_at(upto, F.lit(-1))["last"].alias("l"), F.get(after, F.lit(0))["first"].alias("r")
    )
    slope = (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
    value = (
        F.when(F.col("l").isNull(), F.col("r.y"))
        .when(F.col("r").isNull(), F.col("l.y"))
        .otherwise(F.col("l.y") + slope * (F.col("grid") - F.col("l.x")))
    )
    return d.select(*keys, "grid_index", "grid", value.alias("value"))


def linspace(low: float, high: float, n: int) -> list[float]:
    if n == 1:
        return [low]
    return [low + (high - low) * i / (n - 1) for i in range(n)]

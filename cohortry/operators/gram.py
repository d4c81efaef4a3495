"""Sums of products of all column pairs in one scan, as tiles of a blocked Gram matrix.

A pass packs the columns of a row into one array.  Each task multiplies blocks of columns
batch by batch (X_i'X_j) and keeps the running tiles; what leaves a task is its tiles, and
tiles of the same place are added one after another, wherever they meet.  With missing
values a tile also counts, for every pair, the rows that have both, and sums each side over
those rows alone, so every pair has its own complete rows.  No p x p matrix meets on the
driver, and the plan has one scan whatever the number of columns.

Sums are taken around the first values a task sees, which keeps them small; tiles of
other tasks are moved to a common centre when they are added, which changes nothing else.

Where the tiles of all columns would not fit a task, they are worked off in stripes: rows
are sorted by stripe inside their partition and one stripe is held at a time.  Groups are
sorted the same way, so a group is never gathered, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

#: Columns of a block, and bytes of running tiles a task may hold.
BLOCK = 128
HELD = 256 << 20
#: The centres and the six sums of a pair.
SUMS = ["cx", "cy", "n", "x", "y", "xx", "yy", "xy"]
_PARTS = len(SUMS) - 2


def _tile_list(p: int, block: int) -> list[tuple[int, int]]:
    n = -(-p // block)
    return [(i, j) for i in range(n) for j in range(i, n)]


def _span(k: int, block: int, p: int) -> slice:
    return slice(k * block, min(p, (k + 1) * block))


def _products(x: np.ndarray, i: slice, j: slice, whole: bool) -> np.ndarray:
    """The six sums of a tile over the rows of ``x``; missing values are NaN."""
    a, b = x[:, i], x[:, j]
    out = np.empty((_PARTS, a.shape[1], b.shape[1]))
    if whole:
        out[0] = len(x)
        out[1], out[2] = a.sum(axis=0)[:, None], b.sum(axis=0)[None, :]
        out[3], out[4] = (a * a).sum(axis=0)[:, None], (b * b).sum(axis=0)[None, :]
        out[5] = a.T @ b
        return out
    here, there = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(here, a, 0.0), np.where(there, b, 0.0)
    here, there = here.astype(float), there.astype(float)
    out[0], out[1], out[2] = here.T @ there, a.T @ there, here.T @ b
    out[3], out[4], out[5] = (a * a).T @ there, here.T @ (b * b), a.T @ b
    return out


def moved(sums: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The sums of a tile after ``dx`` and ``dy`` are added to the values of its columns."""
    n, x, y, xx, yy, xy = sums
    dx, dy = dx[:, None], dy[None, :]
    return np.stack([n, x + n * dx, y + n * dy, xx + 2 * dx * x + n * dx * dx, yy + 2 * dy * y + n * dy * dy, xy + dx * y + dy * x + n * dx * dy])


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Stretches of rows with equal ``names``, nulls being equal."""
    change = np.zeros(batch.num_rows, dtype=bool)
    change[:1] = True
    for name in names:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(change)
    yield from zip(at, np.append(at[1:], batch.num_rows))


def _values(column: pa.Array, p: int) -> np.ndarray:
    """Rows by columns, missing values as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, p)


def _sum_tiles(p: int, block: int, stripes: list[list[tuple[int, int]]], keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group, centre, tiles = None, None, None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (i, j), sums in tiles.items():
                body = np.concatenate([centre[_span(i, block, p)], centre[_span(j, block, p)], sums.ravel()]).tobytes()
                yield pa.RecordBatch.from_arrays([*group, pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([body], pa.binary())], names=[*keys, "bi", "bj", "tile"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch.column("v"), p)
            for lo, hi in _runs(batch, ["stripe", *keys]):
                now = [batch.column(c).slice(lo, 1) for c in ("stripe", *keys)]
                if place is None or any(not a.equals(b) for a, b in zip(now, place)):
                    yield from flush()
                    place, group, tiles = now, now[1:], {}
                    seen = ~np.isnan(values[lo:hi])
                    centre = np.where(seen, values[lo:hi], 0.0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1)
                x = values[lo:hi] - centre
                whole = not np.isnan(x).any()
                for i, j in stripes[now[0][0].as_py()]:
                    part = _products(x, _span(i, block, p), _span(j, block, p), whole)
                    if (i, j) in tiles:
                        tiles[i, j] += part
                    else:
                        tiles[i, j] = part
        yield from flush()

    return run


def unpack_tile(raw: bytes, ni: int, nj: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(raw, dtype=np.float64)
    return flat[:ni], flat[ni : ni + nj], flat[ni + nj :].reshape(_PARTS, ni, nj)


def _add_tiles(p: int, block: int, keys: list[str], columns: Sequence[str], schema: pa.Schema, diagonal: bool):
    names = np.array(list(columns), dtype=object)

    def rows(group, i: int, j: int, centre, sums) -> pa.RecordBatch:
        first, second = np.arange(p)[_span(i, block, p)], np.arange(p)[_span(j, block, p)]
        a, b = np.meshgrid(first, second, indexing="ij")
        take = (a <= b) if diagonal else (a < b)
        a, b = a[take], b[take]
        many = len(a)
        data = [pa.concat_arrays([g] * many) if many else g.slice(0, 0) for g in group]
        data += [pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
        data += [pa.array(centre[0][a - first[0]]), pa.array(centre[1][b - second[0]])]
        data += [pa.array(s[take]) for s in sums]
        return pa.RecordBatch.from_arrays(data, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, centre, total = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                now = [batch.column(c).slice(k, 1) for c in (*keys, "bi", "bj")]
                i, j = now[-2][0].as_py(), now[-1][0].as_py()
                ci, cj, sums = unpack_tile(batch.column("tile")[k].as_py(), *(len(range(p)[_span(t, block, p)]) for t in (i, j)))
                if place is not None and all(a.equals(b) for a, b in zip(now, place)):
                    total += moved(sums, ci - centre[0], cj - centre[1])
                    continue
                if place is not None:
                    yield rows(place[:-2], place[-2][0].as_py(), place[-1][0].as_py(), centre, total)
                place, centre, total = now, (ci, cj), sums.copy()
        if place is not None:
            yield rows(place[:-2], place[-2][0].as_py(), place[-1][0].as_py(), centre, total)

    return run


def packed_columns(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def pair_sums(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), values: Column | None = None, diagonal: bool = False, block: int = BLOCK, held: int = HELD
) -> DataFrame:
    """A row for each pair of columns (a before b): keys, feature_a, feature_b, position_a, position_b, cx, cy, n, x, y, xx, yy, xy.

    ``values`` is an array with one number for each of ``columns``; without it they are columns of ``df``.
    ``n`` counts the rows that have both values; the sums are taken over those rows, of the values less ``cx`` and
    ``cy``.  With ``diagonal`` each column is also paired with itself.  NaN counts as missing.  An empty table has no rows.
    """
    columns, keys = list(columns), list(keys)
    p = len(columns)
    tiles = _tile_list(p, block)
    per = max(1, held // (_PARTS * 8 * min(block, max(p, 1)) ** 2))
    stripes = [tiles[k : k + per] for k in range(0, len(tiles), per)] or [[]]
    packed = df.select(*keys, (packed_columns(columns) if values is None else values).alias("v"))
    packed = packed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(len(stripes) - 1))) if len(stripes) > 1 else F.lit(0))
    if keys or len(stripes) > 1:
        packed = packed.sortWithinPartitions("stripe", *keys)
    given = [df.schema[k] for k in keys]
    places = StructType([*given, StructField("bi", IntegerType()), StructField("bj", IntegerType()), StructField("tile", BinaryType())])
    part = packed.mapInArrow(_sum_tiles(p, block, stripes, keys), places)
    pair = [StructField(f"{c}_{side}", kind) for c, kind in (("feature", StringType()), ("position", IntegerType())) for side in "ab"]
    out = StructType([*given, *pair, *[StructField(c, DoubleType()) for c in SUMS]])
    met = part.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")
    return met.mapInArrow(_add_tiles(p, block, keys, columns, to_arrow_schema(out), diagonal), out)


def correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson r from the sums of a pair; 0 where a side does not vary."""
    vx, vy, c = xx - x * x / n, yy - y * y / n, xy - x * y / n
    flat = (vx <= 1e-12 * F.greatest(xx, F.lit(1e-300))) | (vy <= 1e-12 * F.greatest(yy, F.lit(1e-300)))
    r = F.when(flat, 0.0).otherwise(F.try_divide(c, F.sqrt(vx * vy)))
    return F.coalesce(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)), F.lit(0.0))

"""Exact ranks, running sums and quantiles that survive very large groups.

A window or a sorted list over a group meets in one task, which is right for groups
of at most ``GROUP_LIMIT`` rows and wrong beyond.  The functions here measure the
groups first.  Where one is larger, every group is cut along the order key into
buckets, the window runs inside (group, bucket), and the totals of the earlier
buckets, a table of at most ``N_BUCKETS`` rows per group, are added.  Both ways give
the same exact answer; nothing is dropped, capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions.rows import join_same

N_BUCKETS = 32
GROUP_LIMIT = 1_000_000
#: Cells that many groups are counted in.
CELLS = 4096
#: Texts looked at for the edges of text buckets.
EDGE_SAMPLE = 1024
BUCKET = "__bucket"


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None, many: bool = False) -> DataFrame | None:
    """Keys of the groups above the limit, or None.  At most rows/limit keys exist.

    Where there are ``many`` groups, they are first counted together in ``CELLS`` cells of a hash:
    no group is larger than its cell, so only those of cells above the limit are counted apart.
    """
    limit = GROUP_LIMIT if limit is None else limit
    if many and keys:
        cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS))
        full = df.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
        cells = [r["__cell"] for r in full.select("__cell").collect()]  # at most CELLS numbers
        if not cells:
            return None
        df = df.where(cell.isin(cells))
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    big = big.select(*keys) if keys else big
    return None if big.isEmpty() else big


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int | None = None,
    many: bool = False,
) -> DataFrame:
    """``small`` on the groups one task can hold, ``large`` on the others, united."""
    keys = list(keys)
    hot = hot_groups(df, keys, limit, many)
    if hot is None:
        return small(df)
    return small(join_same(df, hot, keys, "left_anti")).unionByName(large(join_same(df, hot, keys, "left_semi")))


def range_edges(df: DataFrame, value: str, n_buckets: int = N_BUCKETS) -> list[float]:
    """Sampled quantile edges of a column: at most ``n_buckets`` numbers."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = df.agg(F.percentile_approx(value, probs, 1000)).first()[0]
    return sorted(set(edges or []))


def edge_bucket(value: Column, edges: Sequence[float], inclusive: bool = False) -> Column:
    """Number of edges below (or at) ``value``, as a decision tree of literals."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(edges[mid])
        return F.when(value >= edge if inclusive else value > edge, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def with_range_bucket(
    df: DataFrame, value: str, n_buckets: int = N_BUCKETS, descending: bool = False, name: str = BUCKET
) -> DataFrame:
    """Add the bucket of ``value`` between the sampled edges of its column."""
    bucket = edge_bucket(F.col(value), range_edges(df, value, n_buckets))
    return df.withColumn(name, -bucket if descending else bucket)


def text_bucket(df: DataFrame, column: str, n_buckets: int = N_BUCKETS) -> Column:
    """Bucket of a text between edges taken from a hash sample of its distinct values.

    Texts that share a long beginning are told apart, which a prefix could not do.  The
    sample only places the edges; it has at most ``EDGE_SAMPLE`` rows.
    """
    text = F.col(column).cast("string")
    drawn = df.select(text.alias("t")).where("t is not null").distinct().orderBy(F.xxhash64("t"), "t").limit(EDGE_SAMPLE)
    texts = sorted(r[0] for r in drawn.collect())
    edges = sorted({texts[len(texts) * i // n_buckets] for i in range(1, n_buckets)}) if texts else []
    return edge_bucket(text, edges)


def _offsets(binned: DataFrame, keys: Sequence[str], bucket: str, names: Sequence[str]) -> DataFrame:
    """Per (keys, bucket): sums over earlier buckets and over the whole group.

    The table is stored at once: Spark then knows how short it is and does not move the rows to meet it.
    """
    totals = binned.groupBy(*keys, bucket).agg(*[F.sum(n).alias(n) for n in names])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    out = totals.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__off_{n}") for n in names],
        *[F.sum(n).over(group).alias(f"total_{n}") for n in names],
    ).persist()
    out.count()
    return out


def value_runs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    n_buckets: int = N_BUCKETS,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per (keys, distinct value) with per-value sums and running sums.

    Columns: keys, value, ``<name>``, ``before_<name>`` (sum over smaller values),
    ``total_<name>`` and the bucket.  Rows are combined per value before the
    shuffle, so a value shared by many rows costs one row per map task.  ``held`` takes
    the stored table, for callers who release it once they have read the result.
    """
    sums = dict(sums or {"n": F.lit(1).cast("bigint")})
    names = list(sums)
    keys = list(keys)
    base = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .persist()  # measured, then read
    )
    if held is not None:
        held.append(base)
    if hot_groups(base, keys) is None:
        group = W.partitionBy(*keys)
        before = group.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return base.select(
            *keys,
            value,
            *names,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in names],
            *[F.sum(n).over(group).alias(f"total_{n}") for n in names],
            F.lit(0).alias(BUCKET),
        )
    binned = with_range_bucket(base, value, n_buckets)
    binned = binned.repartition(*[F.col(k) for k in keys], F.col(BUCKET))
    inner = W.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = binned.select(
        "*", *[F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(f"__in_{n}") for n in names]
    )
    joined = join_same(local, _offsets(binned, keys, BUCKET, names), [*keys, BUCKET])
    return joined.select(
        *keys,
        value,
        *names,
        *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(f"before_{n}") for n in names],
        *[f"total_{n}" for n in names],
        BUCKET,
    )


def at_position(value: str, position: Column, n: str = "n") -> Column:
    """Aggregate: the value whose run covers a 0-based position of the group."""
    start = F.col(f"before_{n}")
    hit = (start <= position) & (position < start + F.col(n))
    return F.max(F.when(hit, F.col(value)))


def run_quantile(value: str, q: float, n: str = "n") -> Column:
    """Aggregate over ``value_runs``: the linearly interpolated quantile."""
    pos = F.lit(float(q)) * (F.col(f"total_{n}") - 1)
    lo = at_position(value, F.floor(pos), n)
    hi = at_position(value, F.ceil(pos), n)
    frac = F.max(pos - F.floor(pos))
    return lo + (hi - lo) * frac


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    limit: int | None = None,
) -> DataFrame:
    """Exact linear quantiles per group, with the number of values ``n``."""
    keys = list(keys)
    df = df.select(*keys, value)

    def small(d: DataFrame) -> DataFrame:
        qs = F.percentile(value, list(quantiles.values()))
        d = d.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), qs.alias("__q"))
        return d.select(*keys, "n", *[F.col("__q")[i].alias(name) for i, name in enumerate(quantiles)])

    def large(d: DataFrame) -> DataFrame:
        runs = value_runs(d, keys, value)
        picked = [run_quantile(value, q).alias(name) for name, q in quantiles.items()]
        return runs.groupBy(*keys).agg(F.max("total_n").alias("n"), *picked)

    return by_group_size(df, keys, small, large, limit)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Callable[[DataFrame], DataFrame] | Column,
    name: str = "row_index",
    total: str | None = None,
    limit: int | None = None,
    largest: int | None = None,
    order_late: bool = False,
) -> DataFrame:
    """0-based row number per group (and optionally the group size).

    ``largest`` is the size of the largest group where the caller knows it, which
    saves measuring it.

    ``bucket`` is used only when a group is above the limit: a column that is
    monotone in ``order``, or a function adding such a column named ``BUCKET``.

    With ``order_late`` the rows are moved first and ``order``, which holds expressions then,
    is worked out where they arrive, so a digest is not shuffled with them.
    """
    keys = list(keys)
    moved = lambda d, *by: d.repartition(*[F.col(k) for k in by]) if order_late and by else d
    limit = GROUP_LIMIT if limit is None else limit
    small = hot_groups(df, keys, limit) is None if largest is None else largest <= limit
    if small:
        group = W.partitionBy(*keys)
        cols = [(F.row_number().over(group.orderBy(*order)) - 1).cast("bigint").alias(name)]
        if total:
            cols.append(F.count(F.lit(1)).over(group).alias(total))
        return moved(df, *keys).select("*", *cols)
    binned = df.withColumn(BUCKET, bucket) if isinstance(bucket, Column) else bucket(df)
    counts = binned.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _offsets(counts, keys, BUCKET, ["__n"])
    inner = W.partitionBy(*keys, BUCKET).orderBy(*order)
    out = join_same(moved(binned, *keys, BUCKET).withColumn("__rn", F.row_number().over(inner)), offsets, [*keys, BUCKET])
    cols = [F.col(c) for c in df.columns if c != BUCKET]
    cols.append((F.col("__off___n") + F.col("__rn") - 1).cast("bigint").alias(name))
    if total:
        cols.append(F.col("total___n").alias(total))
    return out.select(*cols)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], accuracy: int = 2000
) -> dict[str, list[float | None]]:
    """Exact linear quantiles of whole columns, collected as ``len(columns)`` rows.

    Scan 1 brackets every wanted order statistic with a mergeable sketch; scan 2
    keeps only the values inside the brackets (about 4/accuracy of the rows per
    quantile) with the number of values below, and selects exactly among them.  If
    a bracket misses, it is widened to the whole column.
    """
    columns, quantiles = list(columns), list(quantiles)
    if not columns or not quantiles:
        return {c: [] for c in columns}
    slack = 2.0 / accuracy
    probs = []
    for q in quantiles:
        probs += [max(0.0, q - slack), min(1.0, q + slack)]
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.percentile_approx(c, probs, accuracy).alias(f"s{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
            F.count(c).alias(f"n{i}"),
        ]
    head = df.agg(*aggs).first()
    out: dict[str, list[float | None]] = {c: [None] * len(quantiles) for c in columns}
    todo = {
        (i, j): (
            head[f"lo{i}"] if q <= slack else head[f"s{i}"][2 * j],
            head[f"hi{i}"] if q >= 1 - slack else head[f"s{i}"][2 * j + 1],
        )
        for i in range(len(columns))
        for j, q in enumerate(quantiles)
        if head[f"n{i}"]
    }
    while todo:
        missed = {}
        for (i, j), got in _select_in_brackets(df, columns, quantiles, head, todo).items():
            if got is None:
                missed[i, j] = (head[f"lo{i}"], head[f"hi{i}"])
            else:
                out[columns[i]][j] = got
        if missed == todo:
            raise RuntimeError("quantile selection did not converge")
        todo = missed
    return out


def _select_in_brackets(df, columns, quantiles, head, brackets):
    """Exact quantiles whose order statistics lie inside the brackets (else None)."""
    sizes = []
    for (i, j), (lo, hi) in brackets.items():
        c = F.col(columns[i])
        sizes += [F.count_if(c < lo).alias(f"b{i}_{j}"), F.count_if(c.between(lo, hi)).alias(f"w{i}_{j}")]
    found = df.agg(*sizes).first()
    items = [
        F.when(
            F.col(columns[i]).between(F.lit(lo), F.lit(hi)),
            F.struct(F.lit(f"{i}_{j}").alias("slot"), F.col(columns[i]).cast("double").alias("value")),
        )
        for (i, j), (lo, hi) in brackets.items()
    ]
    inside = df.select(F.explode(F.array_compact(F.array(*items))).alias("e")).select("e.slot", "e.value")
    wanted = {}  # slot -> positions inside its bracket
    for i, j in brackets:
        pos = quantiles[j] * (head[f"n{i}"] - 1)
        start = found[f"b{i}_{j}"]
        wanted[f"{i}_{j}"] = (math.floor(pos) - start, math.ceil(pos) - start, pos - math.floor(pos))
    runs = value_runs(inside, ["slot"], "value")
    at = [F.create_map(*[x for s, w in wanted.items() for x in (F.lit(s), F.lit(w[k]))])[F.col("slot")] for k in (0, 1)]
    picked = runs.groupBy("slot").agg(at_position("value", at[0]).alias("lo"), at_position("value", at[1]).alias("hi"))
    got = {r["slot"]: [r["lo"], r["hi"]] for r in picked.collect()}
    out = {}
    for i, j in brackets:
        lo, hi = got.get(f"{i}_{j}", [None, None])
        frac = wanted[f"{i}_{j}"][2]
        out[i, j] = None if lo is None or hi is None else lo + (hi - lo) * frac
    return out

"""Ranks of very many scores: every score is shuffled once, packed, into a range of scores.

Tasks sort batches of scores and write, per cell and range, the distinct scores with their
rows and positives as one value.  A range then meets in one task; what it adds to the rank
sum of its cell needs of the smaller ranges only their number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Rows of a cell that a range holds on average.
RANGE_ROWS = 1_000_000
#: Scores sorted at once where they are packed.
BATCH = 500_000
PACKED = "cell int, part int, size int, packed binary"


def _bytes(numbers: np.ndarray) -> bytes:
    """Equal bytes of the numbers side by side, which the shuffle compresses."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, size).T).view("<i8").ravel()


def _combined(scores: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct scores (the numbers of their bits) in order of the group and the score, with the sums of the counts."""
    order = np.argsort(scores)
    if group is not None:
        order = order[np.argsort(group[order], kind="stable")]
    bits = scores[order].view(np.int64)
    new = np.ones(len(bits), bool)
    new[1:] = bits[1:] != bits[:-1]
    if group is not None:
        group = group[order]
        new[1:] |= group[1:] != group[:-1]
    start = np.flatnonzero(new)
    n, pos = (np.add.reduceat(x[order], start) for x in (n, pos))
    return bits[start], n, pos, None if group is None else group[start]


def _plain(scores: np.ndarray) -> np.ndarray:
    """One bit pattern for zero and one for NaN."""
    scores = scores + 0.0
    scores[np.isnan(scores)] = np.nan
    return scores


def _packer(edges: Sequence[float]):
    limits = np.asarray(edges, float)
    parts = len(limits) + 1

    def emit(held: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(held)
        scores = _plain(d["p"].to_numpy())
        place = d["cell"].to_numpy(np.int64) * parts + np.searchsorted(limits, scores)
        place = place.astype(np.min_scalar_type(int(place.max())))  # numbers of two bytes are sorted by their digits
        bits, n, pos, place = _combined(scores, np.ones(len(d), np.int64), d["y"].to_numpy(np.int64), place)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        starts, ends = [0, *cut], [*cut, len(place)]
        data = [b"".join((_bytes(np.diff(bits[a:b], prepend=0)), _bytes(n[a:b]), _bytes(pos[a:b]))) for a, b in zip(starts, ends)]
        first = place[starts].astype(np.int64)
        return pd.DataFrame({"cell": first // parts, "part": first % parts, "size": np.subtract(ends, starts), "packed": data})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
            if rows >= BATCH:
                yield emit(held)
                held, rows = [], 0
        if held:
            yield emit(held)

    return pack


def _range_sums(packs: pd.DataFrame) -> pd.DataFrame:
    """Rows, positives and twice the rank sum of the positives inside one range."""
    bits, n, pos = [], [], []
    for data, size in zip(packs["packed"], packs["size"]):
        one = [_numbers(data[8 * size * i : 8 * size * (i + 1)], size) for i in range(3)]
        bits.append(np.cumsum(one[0]))
        n.append(one[1])
        pos.append(one[2])
    _, n, pos, _ = _combined(np.concatenate(bits).view(np.float64), np.concatenate(n), np.concatenate(pos))
    twice = int((pos * (2 * (np.cumsum(n) - n) + n + 1)).sum())
    first = packs.iloc[0]
    return pd.DataFrame({"cell": [first["cell"]], "part": [first["part"]], "n": [int(n.sum())], "pos": [int(pos.sum())], "twice": [twice]})


def packed_auroc(df: DataFrame, edges: Sequence[float], cell: str = "cell", score: str = "p", y: str = "y") -> DataFrame:
    """(cell, auroc) with average ranks on ties, null for one class; ``cell`` is a number, ``edges`` cut the scores into ranges.

    The edges decide only how even the ranges are.
    """
    d = df.where(F.col(score).isNotNull()).select(
        F.col(cell).cast("int").alias("cell"),
        F.coalesce(F.col(y).cast("int"), F.lit(0)).alias("y"),
        F.col(score).cast("double").alias("p"),
    )
    ranges = d.mapInPandas(_packer(edges), PACKED).groupBy("cell", "part").applyInPandas(_range_sums, "cell int, part int, n long, pos long, twice long")
    smaller = W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    sums = ranges.groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(exact("twice") + (exact("pos") * exact("before") * 2).cast("decimal(38,0)")).alias("twice")
    )
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    return sums.select("cell", F.when((pos > 0) & (neg > 0), (F.col("twice").cast("double") / 2 - pos * (pos + 1) / 2) / (pos * neg)).alias("auroc"))

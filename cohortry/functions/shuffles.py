"""Permutations of row numbers that are computed, not sorted: a keyed bijection of 0..n-1.

A four-round Feistel network permutes the numbers of the next power of two; a number that
leaves 0..n-1 walks on along its cycle until it is back, which makes the whole a bijection
for any n.  Rounds are products modulo a prime that stay below 2^63, so SQL can repeat them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ROUNDS = 4
PRIME = (1 << 31) - 1
MULTIPLIERS = (1_597_334_677, 48_271)


def round_keys(*parts) -> list[int]:
    """A key below the prime for each round, from the md5 of the parts and the round."""
    text = ":".join(str(p) for p in parts)
    return [int(hashlib.md5(f"{text}:{t}".encode()).hexdigest()[:8], 16) % PRIME for t in range(ROUNDS)]


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and right part of a number below ``n``."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    if bits > 62:
        raise ValueError("row numbers of more than 62 bits")
    return bits // 2, bits - bits // 2


def _step(x: np.ndarray, keys: list[int], left: int, right: int) -> np.ndarray:
    a, b = x >> right, x & ((1 << right) - 1)
    for turn, key in enumerate(keys):
        if turn % 2:
            b = b ^ _mixed(a, key, right)
        else:
            a = a ^ _mixed(b, key, left)
    return (a << right) | b


def _mixed(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    y = (x % PRIME + key) % PRIME * MULTIPLIERS[0] % PRIME
    y = (y ^ (y >> 15)) * MULTIPLIERS[1] % PRIME
    return y & ((1 << bits) - 1)


def permuted(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Images of the numbers ``x`` (each below ``n``)."""
    left, right = halves(n)
    out = _step(x.astype(np.int64), keys, left, right)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = _step(out[far], keys, left, right)
    return out


def permuted_column(x: Column, n: int, keys: list[list[int]]) -> Column:
    """Array with the image of ``x`` under each permutation."""

    @F.pandas_udf("array<long>")
    def images(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(np.column_stack([permuted(part.to_numpy(), n, k) for k in keys])), dtype=object)

    return images(x)

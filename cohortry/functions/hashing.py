"""Deterministic randomness: every draw is a function of md5(seed:key)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(*parts) -> Column:
    """Hex md5 of the parts joined by ':'; strings are columns, other values literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_int(key: Column) -> Column:
    """First 32 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_mod(n: int | Column, *parts) -> Column:
    """Draw from 0..n-1."""
    return F.pmod(hash_int(hash_key(*parts)), F.lit(n) if isinstance(n, int) else n)


def hash_wide(*parts) -> Column:
    """First 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("bigint")


def hash_wide_mod(n: int | Column, *parts) -> Column:
    """Draw from 0..n-1 with 60 bits, for n beyond four billion."""
    return F.pmod(hash_wide(*parts), F.lit(n) if isinstance(n, int) else n)


def hash_bucket(key: Column, hex_digits: int = 2) -> Column:
    """Leading digits of a digest: an evenly filled, order-preserving bucket."""
    return F.substring(key, 1, hex_digits)

"""Small column helpers with explicit null and zero-division rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(c: Column, low, high) -> Column:
    """Clip that keeps null (greatest/least skip nulls); a null bound is open."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def ratio_or_inf(num: Column, den: Column) -> Column:
    """num/den as double, infinity where the denominator is 0."""
    return F.when(den == 0, F.lit(float("inf"))).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q) - F.log(1.0 - q)


def r6(c: Column, digits: int = 6) -> Column:
    """Round for reports.

    The small bias decides exact halves the same way whatever the last bit of
    ``c`` is; adding 0.0 removes a negative zero.
    """
    return F.round(c + F.lit(1e-10), digits) + F.lit(0.0)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def first_digits(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1)


def array_quantile(sorted_array: Column, q: float) -> Column:
    """Linearly interpolated quantile of an ascending array without nulls."""
    pos = F.lit(float(q)) * (F.size(sorted_array) - 1)
    lo = F.get(sorted_array, F.floor(pos).cast("int"))
    hi = F.get(sorted_array, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))

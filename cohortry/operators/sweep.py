"""Variance inflation from stored matrices, shortened by the sweep operator.

A state is one group's correlation matrix or, once that can be inverted, its inverse.  VIFs
are the diagonal of the inverse; taking a column out of an inverse is one rank-one step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Eigenvalues below this share of the largest count as zero.
SINGULAR = 1e-12


def pack(matrix: np.ndarray, inverse: bool) -> bytes:
    return bytes([inverse]) + np.ascontiguousarray(matrix, dtype=np.float64).tobytes()


def unpack(state: bytes) -> tuple[np.ndarray, bool]:
    flat = np.frombuffer(state, dtype=np.float64, offset=1)
    p = int(round(len(flat) ** 0.5))
    return flat.reshape(p, p), bool(state[0])


def swept_out(inverse: np.ndarray, k: int) -> np.ndarray:
    """The inverse of a matrix without its k-th row and column, from the inverse with it."""
    rest = np.delete(np.arange(len(inverse)), k)
    row = inverse[k, rest]
    return inverse[np.ix_(rest, rest)] - np.outer(row, row) / inverse[k, k]


def inverted(matrix: np.ndarray) -> np.ndarray | None:
    """The inverse of a correlation matrix, None where columns determine each other."""
    values, vectors = np.linalg.eigh(matrix)
    if values[0] <= SINGULAR * values[-1]:
        return None
    return (vectors / values) @ vectors.T


def dropped(state: bytes, gone: Sequence[int]) -> tuple[np.ndarray, bool]:
    """The state after the columns of ``gone`` are dropped one after another, each by its place among those left."""
    matrix, inverse = unpack(state)
    for k in gone:
        if not inverse:
            whole = inverted(matrix)
            matrix, inverse = (matrix, False) if whole is None else (whole, True)
        if inverse:
            matrix = swept_out(matrix, k)
        else:
            rest = np.delete(np.arange(len(matrix)), k)
            matrix = matrix[np.ix_(rest, rest)]
    return matrix, inverse


def vif(state: bytes, gone: Sequence[int], cap: float) -> np.ndarray:
    """VIF of the columns left, at most ``cap``, which also stands for columns that others determine."""
    return _measured(*dropped(state, gone), cap)


def eliminated(state: bytes, threshold: float, cap: float) -> list[tuple[int, float]]:
    """Columns dropped one after another, each the one of largest VIF (the first of equals): place in the whole, VIF."""
    places, out = list(range(len(unpack(state)[0]))), []
    while len(places) > 1:
        matrix, inverse = dropped(state, [])
        if not inverse and (whole := inverted(matrix)) is not None:
            matrix, inverse = whole, True
        found = _measured(matrix, inverse, cap)
        worst = int(np.argmax(found))
        if found[worst] <= threshold:
            break
        out.append((places.pop(worst), float(found[worst])))
        state = pack(*dropped(pack(matrix, inverse), [worst]))
    return out


def _measured(matrix: np.ndarray, inverse: bool, cap: float) -> np.ndarray:
    if len(matrix) == 1:
        return np.ones(1)
    if inverse:
        found = np.diag(matrix)
        tied = np.zeros(len(matrix), dtype=bool)
    else:
        values, vectors = np.linalg.eigh(matrix)
        zero = values <= SINGULAR * values[-1]
        # a column that takes part in no dependency has its VIF in the pseudo-inverse
        tied = (vectors[:, zero] ** 2).sum(axis=1) > 1e-9
        found = (vectors[:, ~zero] ** 2 / values[~zero]).sum(axis=1)
    return np.where(tied | ~np.isfinite(found) | (found >= cap) | (found < 1.0 - 1e-9), cap, found)

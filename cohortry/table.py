"""The feature table: one DataFrame plus the order of its feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import nan_to_null


@dataclass(frozen=True)
class FeatureTable:
    """``df`` has a row key, a group key, a label and the named feature columns.

    Feature order matters: pruning keeps the earlier of two collinear columns.
    """

    df: DataFrame
    features: tuple[str, ...]
    row: str = "row_id"
    group: str | None = "group_id"
    y: str | None = "y"
    groups: DataFrame | None = field(default=None)
    labels: DataFrame | None = field(default=None)

    @staticmethod
    def of(df: DataFrame, features: Sequence[str], **kw) -> FeatureTable:
        """Build a table, turning NaN into null so that aggregates skip it."""
        types = dict(df.dtypes)
        missing = [f for f in features if f not in types]
        if missing:
            raise KeyError(f"no such feature columns: {missing}")
        fixed = {f: nan_to_null(F.col(f)) for f in features if types[f] in ("double", "float")}
        return FeatureTable(df.withColumns(fixed) if fixed else df, tuple(features), **kw)

    @property
    def keys(self) -> list[str]:
        return [c for c in (self.row, self.group, self.y) if c]

    def with_features(self, df: DataFrame, features: Sequence[str]) -> FeatureTable:
        return FeatureTable(df, tuple(features), self.row, self.group, self.y, self.groups, self.labels)

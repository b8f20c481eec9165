"""First-wins and last-wins tables without a full sort of each group.

`min_by` and `max_by` are pre-aggregated on the map side, so a key with a large share of the rows sends a row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first in order. Nulls of order come first; columns keep their order."""
    return _one(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes last in order."""
    return _one(df, keys, order, F.max_by)


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    # the kept columns break ties, so that the choice never depends on where rows lie
    row = F.struct(*rest)
    by = F.struct(_order(order), F.to_json(row)) if any(t.startswith(("map", "variant")) for _, t in df.dtypes) else F.struct(_order(order), row)
    return df.groupBy(*keys).agg(pick(row, by).alias("row")).select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])

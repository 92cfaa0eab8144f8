"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Broadcast-hint ``df`` only if it has at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows, so the check is cheap even when
    the side turns out to be large; beyond the bound the join is left to the
    planner (sort-merge, or an adaptive runtime broadcast if it is small after
    all)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

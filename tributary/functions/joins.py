"""Broadcasts of sides whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slim rows that go to every task; a longer side is joined by a shuffle, with the same result.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows. Counts no more than it needs to."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

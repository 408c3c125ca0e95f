"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast if it has at most `most` rows; otherwise df as it is, and the join finds its own way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

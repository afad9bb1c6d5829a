"""Top-k per key (AGG6, SRT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1.

    The rank limit reaches the scan side of the shuffle, so a hot key sends at most ``k`` rows from each task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= k)

"""Repeatable samples (SMP1, SMP2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(seed: int, *keys) -> Column:
    """A number in [0, 1) from a seed and key columns, the same for any partitioning of the rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def sample_rows(df: DataFrame, id_col: str, size: int, seed: int = 0, total: int | None = None) -> DataFrame:
    """About ``size`` rows without replacement, all rows if there are fewer (SMP1)."""
    total = df.count() if total is None else total
    fraction = min(1.0, size / total) if total else 1.0
    return df if fraction >= 1.0 else df.where(unit_hash(seed, id_col) < fraction)


def size_samples(df: DataFrame, id_col: str, sizes: Sequence[int], seed: int = 0, total: int | None = None) -> DataFrame:
    """Independent Bernoulli samples of several expected sizes in one pass, marked by ``sample`` (SMP2)."""
    total = df.count() if total is None else total
    drawn = [
        F.when(unit_hash(seed, F.lit(str(i)), id_col) * total < size, F.lit(i)) for i, size in enumerate(sizes)
    ]
    picked = F.filter(F.array(*drawn), lambda i: i.isNotNull())
    return df.withColumn("sample", F.explode(picked))

"""Join a large table with a lookup table whose keys are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 8


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup table; reads at most ``max_rows + 1`` of its rows."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in dim.columns), F.lit(16))
    rows, size = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(big: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS,
                small: bool | None = None) -> DataFrame:
    """Join ``big`` with ``dim`` (unique on ``on``): broadcast if measured small, otherwise a salted shuffle join.

    Salting spreads the rows of a hot key of ``big`` over ``salts`` partitions and repeats each lookup row once per
    salt, so one frequent word cannot fill a task; what is still uneven is split by adaptive execution. ``small`` skips the measuring where the caller already knows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do {how}")
    if small is None:
        small = fits_broadcast(dim)
    if small:
        return big.join(F.broadcast(dim), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    salted = big.withColumn("_salt", salt)
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")

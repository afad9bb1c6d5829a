"""A filter of a measured set of words, applied inside list expressions before anything is exploded (JOIN2, ARR7)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS

SLOTS_PER_WORD = 16
LEAST_SLOTS = 1024


def _slots(word: Column, size: int) -> list[Column]:
    """Two places of a word among ``size``."""
    return [F.pmod(h, F.lit(size)).cast("int") for h in (F.xxhash64(word), F.xxhash64(F.lit("second"), word))]


def maybe_among(words: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[bool, Callable[[Column], Column] | None]:
    """Whether the different words ``(word)`` fit a broadcast, and if so a test that passes all of them and few others.

    The test is a Bloom filter with two probes and a byte for each slot, kept as one literal: it has no join, is evaluated
    in the list expression, and passes about one other word in seventy. Words that do not fit have no test.
    """
    hashed = words.select(F.xxhash64("word").alias("a"), F.xxhash64(F.lit("second"), "word").alias("b"), (F.octet_length("word") + 16).alias("n"))
    # at most one row more than a broadcast may have
    table = hashed.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or (table.num_rows and sum(table["n"].to_pylist()) > max_bytes):
        return False, None
    size = max(LEAST_SLOTS, SLOTS_PER_WORD * table.num_rows)
    slots = np.zeros(size, dtype=np.uint8)
    for name in ("a", "b"):
        slots[table[name].to_numpy() % size] = 1
    held = F.lit(slots.tobytes())

    def test(word: Column) -> Column:
        first, second = (F.substring(held, at + 1, F.lit(1)) == F.lit(b"\x01") for at in _slots(word, size))
        return first & second

    return True, test

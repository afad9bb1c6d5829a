"""Shuffled shards of equal row counts, by a keyed permutation of row numbers.

All rows are numbered in an order of their contents, and a Feistel network permutes the numbers. The network works on pairs
(left, right) with left below a and right below b, where a and b are about the square root of the number of rows n: each
round adds to one half a keyed function of the other. It permutes 0 ... a * b - 1; a number that leaves 0 ... n - 1 goes
through the network again until it is back (cycle walking), which permutes 0 ... n - 1 itself. Row number r then stands at
place p of the shuffle, in shard p % shards at slot p // shards: counts of rows differ by one at most, slots have no gap,
and nothing but n and the key is needed to find the shard and slot of a row, or the row at a shard and slot.

The order of rows is that of id, checksum and length of the text and a hash of all columns, so shards do not depend on
files or partitions; equal rows are interchangeable. Only these numbers move for the assignment, by ranges of equal size
whatever repeats. Null ids come first; a null text counts as empty; an empty table gives an empty result; extra columns
are ignored by ``assigned`` and kept by ``sharded`` and ``write_shards``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import col, fresh
from titlekit.operators.vocabulary import numbered
from titlekit.session import materialise

ROUNDS = 8
PRIME = (1 << 31) - 1
OVERHEAD = 8


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A factor (not 0) and a summand below PRIME for each round, by a linear congruence from the key."""
    out = []
    state = key % PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 48271 + 11) % PRIME
            pair.append(state)
        out.append((pair[0] or 1, pair[1]))
    return out


class Permutation:
    """A keyed permutation of 0 ... n - 1, for arrays of numbers; the inverse as well. n may go up to 2 ** 62."""

    def __init__(self, n: int, key: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.a = math.isqrt(max(n - 1, 0)) + 1
        self.b = max(-(-n // self.a), 1)
        self.keys = round_keys(key, rounds)

    def _function(self, x: np.ndarray, k: int) -> np.ndarray:
        """Quadratic in x modulo a prime; all products stay below 2 ** 63."""
        factor, summand = self.keys[k]
        y = (x % PRIME * factor + summand) % PRIME
        return (y * y + factor) % PRIME

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x % self.a, x // self.a
        steps = range(len(self.keys))
        for k in reversed(steps) if back else steps:
            sign = -1 if back else 1
            if k % 2 == 0:
                left = (left + sign * self._function(right, k)) % self.a
            else:
                right = (right + sign * self._function(left, k)) % self.b
        return right * self.a + left

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.int64), back)
        while (outside := np.flatnonzero(x >= self.n)).size:
            x[outside] = self._once(x[outside], back)
        return x

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where each row number stands in the shuffle."""
        return self._walked(rows, False)

    def rows(self, places: np.ndarray) -> np.ndarray:
        """Which row number stands at each place."""
        return self._walked(places, True)


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 0) -> int:
    """The number of the row that is at a shard and slot of n shuffled rows."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < n):
        raise ValueError("no row there")
    return int(Permutation(n, key).rows(np.array([place]))[0])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns that order its rows: id, checksum and size of the text, a hash of the row, and the
    place in the input, which tells equal rows apart."""
    text = F.coalesce(col(text_col), F.lit("")).cast("binary")
    keys = {
        "id": col(id_col),
        "text_crc32": F.crc32(text),
        "size": (F.octet_length(text) + OVERHEAD).cast("bigint"),
        "hash": F.xxhash64(*[col(c) for c in docs.columns]),
        "tie": F.monotonically_increasing_id(),
    }
    names = [fresh(docs, f"key_{k}") for k in keys]
    return docs.withColumns(dict(zip(names, keys.values()))), names


def _placed(rows: DataFrame, names: list[str], shards: int, key: int, shard: str, slot: str) -> DataFrame:
    """Rows (written down) numbered in the order of the columns ``names``, with shard and slot in columns of those names."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    number, at = fresh(rows, "row_number"), fresh(rows, "place")
    permutation = Permutation(rows.count(), key)

    @F.pandas_udf("bigint")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.places(row.to_numpy()))

    out = numbered(rows, [F.col(n).asc_nulls_first() for n in names], number).withColumn(at, place(F.col(number)))
    return out.withColumns({shard: (F.col(at) % shards).cast("int"), slot: F.expr(f"`{at}` div {shards}")}).drop(number, at)


def assigned(docs: DataFrame, shards: int, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; the size is the bytes of the text and ``OVERHEAD``."""
    keyed, names = _keyed(docs, id_col, text_col)
    narrow = materialise(keyed.select(*names))  # the texts are read once
    out = _placed(narrow, names, shards, key, "shard", "slot")
    return out.select(F.col(names[0]).alias(id_col), F.col(names[2]).alias("size"), F.col(names[1]).alias("text_crc32"), "shard", "slot")


def sharded(docs: DataFrame, shards: int, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their columns, then shard and slot (named ``shard`` and ``slot``, with ``_`` if these are taken)."""
    keyed, names = _keyed(docs, id_col, text_col)
    return _placed(materialise(keyed), names, shards, key, fresh(docs, "shard"), fresh(docs, "slot")).drop(*names)


def write_shards(docs: DataFrame, folder: str, shards: int, key: int = 0, rows_in_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows as Parquet, a folder ``shard=k`` for each shard, whose files hold runs of slots in order.

    Rows go to tasks by shard and run of ``rows_in_file`` slots, so a shard of any size is written by many tasks.
    """
    out = sharded(docs, shards, key, id_col, text_col)
    shard, slot = out.columns[-2:]
    run = fresh(out, "run")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = out.withColumn(run, F.expr(f"`{slot}` div {rows_in_file}")).repartitionByRange(parts, shard, run)
    cut.sortWithinPartitions(shard, slot).drop(run).write.partitionBy(shard).parquet(folder)

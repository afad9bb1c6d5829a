from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlekit.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 1000, 4097])
def test_permutation(n):
    p = sharding.Permutation(n, 7)
    places = p.places(np.arange(n))
    assert sorted(places) == list(range(n)) and p.rows(places).tolist() == list(range(n))
    if n > 100:
        assert places.tolist() != sharding.Permutation(n, 8).places(np.arange(n)).tolist()
        moved = np.abs(places - np.arange(n)).mean() / n
        assert 0.28 < moved < 0.39  # a third for a random order


def test_very_large_numbers():
    n = 10**18 + 9
    p = sharding.Permutation(n, 3)
    some = np.array([0, 1, 2, n // 2, n - 1], dtype=np.int64)
    places = p.places(some)
    assert ((0 <= places) & (places < n)).all() and p.rows(places).tolist() == some.tolist()


def test_neighbours_are_spread():
    """Runs of neighbouring rows fall to all shards alike."""
    places = sharding.Permutation(24_000, 1).places(np.arange(2400))
    counts = np.bincount(places % 24, minlength=24)
    assert counts.min() > 60 and counts.max() < 140


def slow(rows, shards, key):
    """Shard and slot by sorting everything here; equal rows in any order."""
    n = len(rows)
    place = sharding.Permutation(n, key).places(np.arange(n)).tolist()
    ordered = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, h) for i, t, h in rows)
    return sorted(((i[1] if i[0] else None, size, crc, p % shards, p // shards) for (i, crc, size, _), p in zip(ordered, place)), key=repr)


def held(df):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_against_one_sort(spark, odd, nothing, shards):
    hashed = odd.select("doc_id", "text", F.xxhash64(*odd.columns).alias("h")).collect()
    want = slow([(r["doc_id"], r["text"], r["h"]) for r in hashed], shards, 5)
    assert held(sharding.assigned(odd, shards, 5)) == want
    assert held(sharding.assigned(odd.repartition(5), shards, 5)) == want
    assert sharding.assigned(nothing, shards).count() == 0 and sharding.sharded(nothing, shards).count() == 0
    with pytest.raises(ValueError):
        sharding.assigned(odd, 0)


def test_whole_rows(spark, odd, tmp_path):
    out = sharding.sharded(odd.withColumn("shard", F.lit("mine")), 4, 5)
    assert out.columns == [*odd.columns, "shard", "shard_", "slot"] and out.where("shard <> 'mine'").count() == 0
    sharding.write_shards(odd, str(tmp_path / "shards"), 4, 5, rows_in_file=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert held(back.select("doc_id", F.lit(0).alias("size"), F.lit(0).alias("text_crc32"), "shard", "slot")) == sorted(((i, 0, 0, s, p) for i, _, _, s, p in held(sharding.assigned(odd, 4, 5))), key=repr)
    assert back.drop("shard", "slot").exceptAll(odd).count() == 0 and back.count() == odd.count()


def test_computed_place(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    found = {(r["shard"], r["slot"]): r["doc_id"] for r in sharding.assigned(rows, 24, 9).collect()}
    counts = Counter(s for s, _ in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(found) == 1000
    for s, n in counts.items():
        assert {slot for shard, slot in found if shard == s} == set(range(n))
    assert all(sharding.row_at(s, p, 1000, 24, 9) == i for (s, p), i in list(found.items())[::37])
    with pytest.raises(ValueError):
        sharding.row_at(23, 41, 1000, 24, 9)


def test_half_of_the_rows_equal(spark):
    rows = spark.range(3000).selectExpr("if(id % 2 = 0, 0L, id) AS doc_id", "if(id % 2 = 0, 'same', concat('t', id)) AS text")
    out = sharding.assigned(rows, 24, 1)
    assert out.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert out.select("shard", "slot").distinct().count() == 3000


def test_text_that_is_not_utf8(spark):
    rows = spark.sql("SELECT 1L AS doc_id, cast(X'ff4162' AS string) AS text")
    assert held(sharding.assigned(rows, 2)) == [(1, 11, zlib.crc32(b"\xffAb"), 0, 0)]

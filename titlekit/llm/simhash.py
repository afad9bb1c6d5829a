"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 32 segments of two bits. Its segments' bit counts are a point with 32 coordinates from 0 to 2,
and the Manhattan distance of two points is never more than the Hamming distance of their fingerprints. A link (at most
two differing bits) therefore joins points at distance 0 to 2, and two such points always have a grid point within
distance 1 of both. So every distinct fingerprint is entered at its own grid point and at the neighbours of that, about
49 places, and fingerprints that meet nowhere are done with.

Those that meet are verified exactly and without forming pairs: two fingerprints differ in at most two bits if and only
if some 64-bit word differs from each of them in at most one bit, and that word's own point is a place where they meet.
In each place shared by several fingerprints, each writes down the words within one bit of it that belong to that place
(two at most); fingerprints at the same word are linked. A word has at most 65 fingerprints round it, so a group of any
number of near copies makes links in proportion to its members.

Null and empty texts have fingerprint zero and are linked like others; repeated rows and ties share a fingerprint. Extra
columns are ignored. An empty table gives an empty result. A null id has no part in the smallest id; a component whose
ids are all null has a null id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import by_slice, col, fresh
from titlekit.llm.components import components
from titlekit.session import materialise, spread

SEED = 42
EVEN_BITS = 0x5555555555555555
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of the shingles of ``words`` words; the sum of bits is exact for a text of any length."""
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    total = np.zeros(64, dtype=np.int64)
    n = len(parts) - words + 1
    for start in range(0, n, SHINGLES_AT_ONCE):
        some = parts[start : min(start + SHINGLES_AT_ONCE, n) + words - 1]
        codes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(some[k:] for k in range(words))))], dtype="<u8")
        total += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every text as a signed 64-bit number."""
    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))

    def compute(texts: list[bytes]) -> list:
        return [np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)]

    return by_slice(rows, compute, "fp bigint")


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 segments, in two bits each."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def places(fp: Column) -> Column:
    """The grid points within distance 1 of the fingerprint's point: (cell, step), step 0 for the point itself, else
    the number of the segment, from 1, with the sign of the move."""
    def moves(i: Column, point: Column) -> Column:
        at = (2 * i).cast("int")
        count = F.call_function("shiftrightunsigned", point, at).bitwiseAND(F.lit(3))

        def moved(by: int, step: Column) -> Column:
            change = count.bitwiseXOR(count + by)
            return F.struct(point.bitwiseXOR(F.call_function("shiftleft", change, at)).alias("cell"), step.cast("int").alias("step"))

        up, down = F.when(count < 2, moved(1, i + 1)), F.when(count > 0, moved(-1, -i - 1))
        return F.filter(F.array(up, down), lambda x: x.isNotNull())

    def around(point: Column) -> Column:
        here = F.array(F.struct(point.alias("cell"), F.lit(0).alias("step")))
        return F.concat(here, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: moves(i, point))))

    return F.get(F.transform(F.array(popcounts(fp)), around), 0)


def witnesses(fp: Column, step: Column) -> Column:
    """The 64-bit words within one bit of the fingerprint whose point is the place that ``step`` leads to."""
    one = F.lit(1).cast("bigint")
    low = (2 * (F.abs(step) - 1)).cast("int")

    def flipped(place: Column) -> Column:
        bit = F.call_function("shiftleft", one, place)
        is_set = fp.bitwiseAND(bit) != 0
        return F.when(is_set == (step < 0), fp.bitwiseXOR(bit))

    moved = F.filter(F.array(flipped(low), flipped(low + 1)), lambda x: x.isNotNull())
    return F.when(step == 0, F.array(fp)).otherwise(moved)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all those at most two bits apart.

    Every pair that differs in at most two bits is connected through the lowest fingerprint at their common word, to
    which both are at most two bits.
    """
    # every fingerprint makes some 49 rows, so few bytes of them are much work: as many tasks as the session has partitions
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    entered = fps.select("fp", F.explode(places(F.col("fp"))).alias("at")).select("at.cell", "at.step", "fp")
    shared = entered.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("cell")
    met = entered.join(shared.hint("merge"), "cell")
    near = met.select("fp", F.explode(witnesses(F.col("fp"), F.col("step"))).alias("word"))
    # at most 65 fingerprints are within one bit of a word
    groups = near.groupBy("word").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    pairs = groups.select(F.get("fps", 0).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps") - 1)).alias("b"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of every row, and the number of rows that share the fingerprint."""
    found = materialise(fingerprints(docs, id_col, text_col, words))
    nodes = materialise(found.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_same")))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(placed.join(least, "root").select("fp", "component_id", "n_same"))
    out = found.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id, of equal ids the one with the least hash of
    its columns. A component without any id keeps a row by that hash. Of equal rows one stays.

    The texts are shuffled once: equal rows are merged before and after that shuffle, and the rows that stay are picked
    where they then lie.
    """
    one, two = fresh(docs, "row_key_1"), fresh(docs, "row_key_2")
    columns = [col(c) for c in docs.columns]
    keyed = docs.withColumns({one: F.xxhash64(*columns), two: F.xxhash64(F.lit("second"), *columns)})
    ranked = F.struct(col(id_col).isNull().alias("unknown"), col(id_col).alias("id"), col(one).alias("one"), col(two).alias("two"))
    found = near_duplicates(keyed.select(ranked.alias("id"), col(text_col).alias("text")), "id", "text", words)
    best = found.select("component_id").distinct()
    chosen = materialise(best.select(F.col("component_id.one").alias(one), F.col("component_id.two").alias(two)))
    return keyed.dropDuplicates([one, two]).join(chosen.hint("merge"), [one, two], "left_semi").select(*columns)

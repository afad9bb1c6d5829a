"""What the operators share: rows of text as bytes, words of many texts at once, samples of labelled rows."""

from __future__ import annotations

import collections
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise

SLICE_BYTES = 1 << 20
MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(id_col: str) -> Column:
    """The row may be learned from: its id is known and not held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def texts_of(column: pa.Array) -> list[bytes]:
    """The values as UTF-8; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_text(raw: bytes) -> str:
    """A text's bytes as a string; bytes that are not UTF-8 are read as U+FFFD, so no text ends a job."""
    return raw.decode("utf-8", "replace")


def strings_of(column: pa.Array) -> list[str | None]:
    """The values as strings, read by ``as_text``; null stays null."""
    return [None if x is None else as_text(x) for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text has a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def by_slice(df: DataFrame, function: Callable[[list[bytes]], list], schema: str) -> DataFrame:
    """Columns computed from texts, slice by slice.

    ``df`` has the text as its last column; the columns before it are passed on. ``function`` gets the texts of a slice
    as bytes and returns one array for each further column of ``schema``.
    """
    kept = df.columns[:-1]
    fields = [f"`{c}` {t}" for c, t in df.dtypes[:-1]]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = texts_of(batch.column(len(kept)))
            for a, b in slices(texts):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(texts[a:b])]
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + made, names=kept + names)

    names = [x.split()[0] for x in schema.split(", ")]
    return df.mapInArrow(batches, ", ".join([*fields, schema]))


def byte_set(pattern: str) -> np.ndarray:
    """The bytes of a regular expression's character class, as 256 booleans."""
    found = re.compile(pattern.encode())
    return np.array([bool(found.fullmatch(bytes([i]))) for i in range(256)])


#: White space between words, and the characters of benchmark words in lower case.
SPACED = byte_set(r"[^\x20\x09-\x0D]")
ALNUM = byte_set(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE_BYTES + 4096:
            _powers[base] = have
    return have[:n]


def prefix_codes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_codes`` takes the hash of any span."""
    codes = BYTE_CODE[raw]
    codes *= powers(BASE, len(raw))
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(codes, out=out[1:])
    return out


def span_codes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    code = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mixed(code + (ends - starts).astype(np.uint64) * np.uint64(BASE))


class Words:
    """The words of several texts: where each starts and ends in one buffer, and which text it belongs to.

    ``first[i]`` is the number of text i's first word; ``first`` has one entry more than there are texts. The buffer has
    a blank before, between and after the texts, and a blank is in no word.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.buffer = b" " + b" ".join(texts) + b" "
        self.raw = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))
        self.inside = kind[self.raw]
        change = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        self.starts, self.ends = change[::2], change[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.first)

    def codes(self) -> np.ndarray:
        return span_codes(prefix_codes(self.raw), self.starts, self.ends)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a number for each byte of the buffer, by text."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.text_starts[1:] - 1] - total[self.text_starts[:-1]]

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over first[i]:first[i + 1]."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def within(sizes: list[tuple[object, int]], limit: int) -> list[int]:
    """Places of the (class, bytes) that are taken, in order, so that their bytes stay within ``limit``.

    Every class has the same share, and a class whose smallest text (empty ones aside) is larger gets that from the
    others. A text that does not fit is skipped and the next one tried; what the classes leave over goes to skipped texts
    in order. If not even the smallest texts of all classes fit together, the classes with the largest of them have none.
    """
    least: dict[object, int] = {}
    for y, n in sizes:
        least[y] = min(least.get(y) or n, n or least.get(y, 0))
    order = sorted(least, key=lambda y: least[y])
    left = limit
    while order and sum(least[y] for y in order) > limit:
        order.pop()
    share: dict[object, int] = {}
    for i, y in reversed(list(enumerate(order))):
        share[y] = max(least[y], left // (i + 1))
        left -= share[y]
    taken = set()
    for i, (y, n) in enumerate(sizes):
        if y in share and n <= share[y]:
            share[y] -= n
            taken.add(i)
    left += sum(share.values())
    for i, (_, n) in enumerate(sizes):
        if i not in taken and n <= left:
            left -= n
            taken.add(i)
    return sorted(taken)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int,
                    chars: int) -> list[tuple[bytes, object, float]]:
    """A bounded sample of labelled texts that may be learned from: (text, label, weight).

    From each class, however many there are, come at most ``rows`` ids, the lowest by a hash of the id, so that a rare
    class is not crowded out; one pass ranks the ids of all classes, and a task sends on no more than ``rows`` of each. The
    weights give a class its share among all labelled rows again. Texts are taken in hash order, within ``chars`` bytes
    together and a share of them for each class (``within``); a text that does not fit is skipped. An id labelled twice
    counts with its larger label; an id that stands for several documents gives the longest text. Only these rows reach the
    driver.
    """
    known = labels.select(col(id_col).alias("i"), col(label_col).alias("y"))
    known = known.where("i IS NOT NULL AND y IS NOT NULL").where(learnable("i")).groupBy("i").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not shares:
        return []
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i"))
    chosen = materialise(known.withColumn("place", place).where(F.col("place") <= rows).select("i", "y"))
    own = docs.select(col(id_col).alias("i"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    found = lookup_join(own, chosen, ["i"])
    sizes = found.groupBy("i", "y").agg(F.max(F.octet_length("t")).alias("n")).orderBy(F.xxhash64("i"), "i").collect()
    taken = [(sizes[k]["i"],) for k in within([(r["y"], r["n"]) for r in sizes], chars)]
    if not taken:
        return []
    if len(taken) < len(sizes):
        ids = docs.sparkSession.createDataFrame(taken, f"i {dict(own.dtypes)['i']}")
        found = lookup_join(found, ids, ["i"])
    texts = found.groupBy("i", "y").agg(F.max_by("t", F.struct(F.octet_length("t"), "t")).cast("binary").alias("t")).orderBy(F.xxhash64("i"), "i").collect()
    have = collections.Counter(r["y"] for r in texts)
    return [(bytes(r["t"]), r["y"], shares[r["y"]] / have[r["y"]]) for r in texts]

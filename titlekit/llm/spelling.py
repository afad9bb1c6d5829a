"""Spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

The vocabulary (different words with their counts) is laid out in blocked Bloom filters, one for each length: a word sets
eight bits in one block of 256 bits of its length's filter. Tasks then take words of the vocabulary, generate their edits
(each character deleted, each replaced by every character that the vocabulary has) as hashes only, and probe the filter of
the edit's length. Only edits that are in the filter become strings and are shuffled, to an exact join with the vocabulary,
which removes what the filter let through by mistake. An insertion is the deletion seen from the longer word.

Filters take ``BITS`` bits a word. They are broadcast in parts of at most ``PART_BYTES``: a larger vocabulary is probed in
several passes, each with the blocks of one part and the words whose edits can fall there, so neither what is broadcast nor
the rate of mistakes grows with the data. Words of ``LONG`` characters and more share one filter.

Words are counted before they are shuffled, so a frequent word is no hot key, and a word has no more neighbours than edits.
Null and empty texts have no words; repeated rows count again; an empty table gives an empty result; extra columns are
ignored; texts that are not valid UTF-8 are read with replacement characters, which are in no word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import BASE, INVERSE, MASK64, col, mixed, powers
from titlekit.session import materialise

#: Characters of words once A-Z are lower-case.
LETTERS = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
BITS = 16
BLOCK_BITS = 256
PART_BYTES = 32 << 20
LONG = 256
AT_ONCE = 1 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int = 0) -> DataFrame:
    """(word, n): runs of letters of ``least_chars`` characters and more that occur ``least_count`` times, in lower case.

    With ``damaged=m`` a run loses one character where m divides the crc32 of ``<id>:<run>`` (a null id is empty there):
    the character at that number modulo the run's length.
    """
    text = F.translate(col(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_chars},}}"), 0)
    words = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if damaged:
        h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.select(F.when(h % damaged == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def points(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words, their code points as a matrix) for words of the same length, AT_ONCE points together."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == length)
        step = max(1, AT_ONCE // int(length))
        for some in (own[i : i + step] for i in range(0, len(own), step)):
            raw = "".join(words[i] for i in some).encode("utf-32-le", "surrogatepass")
            yield some, np.frombuffer(raw, dtype="<u4").reshape(len(some), length)


def char_codes(chars: np.ndarray) -> np.ndarray:
    return mixed((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def factors(length: int) -> np.ndarray:
    """The factor of a character at each place of a word."""
    return powers(BASE, length)


class Layout:
    """Where the filter of each length stands in one row of blocks, and the part of them that is at hand."""

    def __init__(self, counts: dict[int, int]):
        self.starts = np.zeros(LONG + 1, dtype=np.int64)
        self.blocks = np.zeros(LONG + 1, dtype=np.uint64)
        at = 0
        for shard in sorted(counts):
            self.starts[shard] = at
            self.blocks[shard] = -(-counts[shard] * BITS // BLOCK_BITS)
            at += int(self.blocks[shard])
        self.total = at

    def place(self, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash (a sum of its characters' codes) among those of the length, and the hash its bits come from."""
        shard = min(length, LONG)
        code = mixed(sums + np.uint64((length * BASE) & MASK64))
        block = self.starts[shard] + (((code >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)).astype(np.int64)
        return block, mixed(code ^ np.uint64(BASE))

    def shards(self, low: int, high: int) -> list[int]:
        """The lengths whose blocks are within low ... high - 1, at least in part."""
        ends = self.starts + self.blocks.astype(np.int64)
        return [int(s) for s in np.flatnonzero((self.blocks > 0) & (self.starts < high) & (ends > low))]


def mask(bits: np.ndarray, k: int) -> np.ndarray:
    """The two bits of a hash in word k, of four, of its block."""
    one = np.uint64(1)
    return (one << ((bits >> np.uint64(12 * k)) & np.uint64(63))) | (one << ((bits >> np.uint64(12 * k + 6)) & np.uint64(63)))


FILTER = "block bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"


def filters(words: DataFrame, layout: Layout) -> DataFrame:
    """(block, w0 ... w3): the blocks with a bit set, from the column ``word``; bits are put together in each task first."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, chars in points(batch.column(0).to_pylist()):
                length = chars.shape[1]
                block, bits = layout.place((char_codes(chars) * factors(length)).sum(axis=1, dtype=np.uint64), length)
                own, at = np.unique(block, return_inverse=True)
                made = []
                for k in range(4):
                    word = np.zeros(len(own), dtype=np.uint64)
                    np.bitwise_or.at(word, at, mask(bits, k))
                    made.append(word.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, *made)], names=["block", "w0", "w1", "w2", "w3"])

    parts = words.select("word").mapInArrow(batches, FILTER)
    return parts.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def _hits(table: np.ndarray, low: int, layout: Layout, sums: np.ndarray, length: int) -> np.ndarray:
    """Which of the hashes are in the filter; those in blocks of other parts are not."""
    block, bits = layout.place(sums, length)
    at = np.flatnonzero((block >= low) & (block < low + len(table)))
    block, bits = block[at] - low, bits[at]
    for k in range(4):  # a word of a block leaves few of those that are in no filter
        own = mask(bits, k)
        found = (table[block, k] & own) == own
        at, block, bits = at[found], block[found], bits[found]
    return at


def candidates(words: DataFrame, layout: Layout, table, low: int, alphabet: list[int]) -> DataFrame:
    """(word, n, edit): edits of (word, n) that are in the broadcast blocks from ``low``."""
    letters = np.array(sorted(alphabet), dtype=np.uint32)
    codes = char_codes(letters)

    def deletions(chars: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, str]]:
        length = chars.shape[1]
        before = np.zeros((len(chars), length + 1), dtype=np.uint64)
        np.cumsum(own, axis=1, dtype=np.uint64, out=before[:, 1:])
        sums = before[:, :length] + (before[:, length:] - before[:, 1:]) * np.uint64(INVERSE)
        # of equal characters in a row the last is deleted
        last = np.ones(chars.shape, dtype=bool)
        last[:, :-1] = chars[:, 1:] != chars[:, :-1]
        row, at = np.nonzero(last)
        for k in _hits(table.value, low, layout, sums[row, at], length - 1):
            yield int(row[k]), text(np.delete(chars[row[k]], at[k]))

    def replacements(chars: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, str]]:
        length = chars.shape[1]
        total, plain = own.sum(axis=1, dtype=np.uint64), char_codes(chars)
        step = max(1, AT_ONCE // len(letters))
        for start in range(0, chars.size, step):
            row, at = np.divmod(np.arange(start, min(start + step, chars.size)), length)
            moved = (codes[None, :] - plain[row, at][:, None]) * factors(length)[at][:, None]
            sums = total[row][:, None] + moved
            other = np.flatnonzero(letters[None, :] != chars[row, at][:, None])
            for k in other[_hits(table.value, low, layout, sums.ravel()[other], length)]:
                i, letter = divmod(int(k), len(letters))
                edit = chars[row[i]].copy()
                edit[at[i]] = letters[letter]
                yield int(row[i]), text(edit)

    def text(chars: np.ndarray) -> str:
        return chars.astype("<u4").tobytes().decode("utf-32-le")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for places, chars in points(words):
                own = char_codes(chars) * factors(chars.shape[1])
                for kind in (deletions, replacements):
                    found = list(kind(chars, own))
                    at = [places[r] for r, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array([counts[i] for i in at], pa.int64()), pa.array([e for _, e in found], pa.string())], names=["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(batches, "word string, n bigint, edit string")


def neighbours(counts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words of (word, n), each word once there, that are one edit apart."""
    spark = counts.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONG))
    layout = Layout({r["s"]: r["count"] for r in counts.groupBy(shard.alias("s")).count().collect()})  # LONG rows at most
    alphabet = [ord(r["c"]) for r in counts.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    blocks = materialise(filters(counts, layout))
    size = max(1, part_bytes * 8 // BLOCK_BITS)
    found = []
    for low in range(0, layout.total, size):
        high = min(low + size, layout.total)
        part = blocks.where((F.col("block") >= low) & (F.col("block") < high)).toArrow()
        table = np.zeros((high - low, 4), dtype=np.uint64)
        at = part["block"].to_numpy() - low
        for k in range(4):
            table[at, k] = part[f"w{k}"].to_numpy().view(np.uint64)
        reached = sorted({n for s in layout.shards(low, high) for n in (s, min(s + 1, LONG))})
        sent = spark.sparkContext.broadcast(table)
        found.append(materialise(candidates(counts.where(shard.isin(reached)), layout, sent, low, alphabet)))
        sent.unpersist()
    if not found:
        return counts.select("word", "n", F.lit("").alias("near"), F.lit(0).cast("bigint").alias("near_n")).where("false")
    maybe = found[0]
    for more in found[1:]:
        maybe = maybe.union(more)
    known = counts.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    links = maybe.join(known.hint("merge"), "edit")
    one = F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    two = F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    shorter = F.char_length("edit") < F.char_length("word")
    return links.select(F.inline(F.when(shorter, F.array(one, two)).otherwise(F.array(one))))


def variants(counts: DataFrame, ratio: int = RATIO, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    The form is the near word of the largest count, the first in code-point order among equals, if that count is
    ``ratio`` (2 at least) times the word's or more; root follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # every word makes some hundreds of edits, so few bytes of them are much work
    counts = materialise(counts.repartition(parts, "word"))
    near = neighbours(counts, part_bytes)
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    often = -F.col("best.n") >= ratio * F.col("n")
    formed = materialise(best.select("word", "n_near", F.when(often, F.col("best.w")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n")))
    out = counts.join(formed.hint("merge"), "word", "left").join(_roots(formed.where("form is not null")).hint("merge"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the steps, and counts grow with every step."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = materialise(roots.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots

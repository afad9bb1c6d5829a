"""Quality rules, and lines that many documents of a host repeat.

Every document gets counts from its own text (words, symbols, repeated lines, words in repeated windows), and two of them
reject it. For the others lines are compared across documents: each line is normalised (lower case, digits as 0, runs of
other characters than letters and digits as one blank) and hashed, and documents of the same host are counted by line.
Lines above the limits are boilerplate; they are taken out, and a document of which too little is left is rejected.

Copies of a document are one document: rows of a host with the same set of normalised lines count once, so a line's count
is the number of distinct documents that hold it, a whole number that no order of rows changes. Whatever else two
documents share, they count as two: pages that are mostly one template are what the count is for, and so are texts of
which one line in six was rewritten. A line above the limits is held by more than ``min_docs`` documents, and by more than
``share`` of the host's rows (0 unless it is given: one absolute limit for every host).

The text is read once; from then on only hashes of lines move. Counts are summed before each shuffle, so a line in every
document is no hot key, and the rows of frequent lines meet their counts by a measured broadcast or a salted join.

Null and empty texts have no words and fail; a null host is a host of its own; repeated rows are documents of their own
(and copies); an empty table gives an empty result; extra columns pass through ``accepted`` and are ignored otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import SPACED, Words, by_slice, byte_set, col, fresh, mixed, powers, span_codes, prefix_codes, strings_of, sums
from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise, spread

#: Fixed values of the rules.
SYMBOLS = byte_set(r"[#*$%&|<>]")
LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
#: Limits of a line in a host, the same at every size of the host, and what must be left of a document.
MIN_DOCS = 20
SHARE = 0.0
LEFT_WORDS = 5
LEFT_SHARE = 0.2

MARKS = re.compile(r"[\W_]+")
DIGITS = re.compile(r"[0-9]")


def normalised(line: bytes) -> bytes:
    text = MARKS.sub(" ", line.decode("utf-8", "replace").lower()).strip()
    return DIGITS.sub("0", text).encode() or line.strip()


def repeated_words(codes: np.ndarray, words: Words) -> np.ndarray:
    """For each text, the words in windows of WINDOW words that stand in the text twice or more."""
    n = len(codes) - WINDOW + 1
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    if n > 0:
        window = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(powers(0x9E3779B97F4A7C15, WINDOW + 1)[1:]):
            window += codes[k : n + k] * factor
        owner = words.owner()
        own = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        keys = mixed(window[own] + mixed(owner[own].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = np.flatnonzero(ordered[1:] == ordered[:-1])
        twice = own[np.unique(order[np.concatenate((same, same + 1))])] if len(same) else same
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return sums(np.cumsum(covered[:-1]) > 0, words.first)


def lines_of(text: bytes) -> tuple[int, dict[bytes, int]]:
    """How many lines repeat an earlier one, and the words of each normalised line (all its repeats together)."""
    seen: set[bytes] = set()
    repeats = 0
    found: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            repeats += line in seen
            seen.add(line)
            plain = normalised(line)
            found[plain] = found.get(plain, 0) + n
    return repeats, found


def measure(texts: list[bytes]) -> list:
    """Counts of each text and the hashes and words of its lines."""
    words = Words(texts, SPACED)
    starts_char = (words.raw & 0xC0) != 0x80
    chars = words.per_text(words.inside & starts_char)
    symbols = words.per_text(SYMBOLS[words.raw])
    repeated = repeated_words(words.codes(), words)
    lines = [lines_of(t) for t in texts]
    flat = [k for _, own in lines for k in own]
    hashes = np.zeros(0, dtype=np.int64)
    if flat:
        raw = b" ".join(flat)
        sizes = np.fromiter((len(k) for k in flat), dtype=np.int64, count=len(flat))
        ends = np.cumsum(sizes + 1) - 1
        hashes = span_codes(prefix_codes(np.frombuffer(raw, dtype=np.uint8)), ends - sizes, ends).view(np.int64)
    counts = pa.array([n for _, own in lines for n in own.values()], pa.int64())
    offsets = np.concatenate(([0], np.cumsum([len(own) for _, own in lines])))
    rows = pa.StructArray.from_arrays([pa.array(hashes), counts], names=["hash", "words"])
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
    return [words.counts.astype(np.int64), chars, symbols, np.array([r for r, _ in lines], dtype=np.int64), repeated, listed]


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<hash:bigint,words:bigint>>"


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def judged(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """Counts and verdict of rows (any columns, then host, then text); the text is not passed on."""
    measured = by_slice(spread(rows), measure, MEASURES)
    marked = measured.withColumns({"row": F.monotonically_increasing_id(), "failed": base_failed()})
    kept = materialise(marked)  # row numbers stay as they are written down here
    host_key = F.xxhash64(F.coalesce(F.col("host"), F.lit("")), F.col("host").isNull())
    copy = F.xxhash64(F.array_sort(F.transform("lines", lambda x: x["hash"])))  # rows with equal lines are one document
    lines = kept.select("row", host_key.alias("host_key"), copy.alias("copy"), F.inline("lines"))
    lines = lines.withColumn("line", F.xxhash64("host_key", "hash"))

    hosts = kept.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    hosts = hosts.select(host_key.alias("host_key"), F.greatest(F.lit(float(min_docs)), share * F.col("docs")).alias("limit"))
    often = lines.groupBy("line", "host_key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > min_docs)
    often = materialise(lookup_join(often, hosts, ["host_key"]).where("rows > limit").select("line", "limit"))

    # only lines with so many rows can have so many documents
    found = materialise(lookup_join(lines.select("row", "line", "hash", "words", "copy"), often, ["line"]))
    docs = found.select("line", "limit", "copy").distinct().groupBy("line", "limit").agg(F.count(F.lit(1)).alias("docs"))
    common = materialise(docs.where("docs > limit").select("line"))
    gone = lookup_join(found.select("row", "line", "hash", "words"), common, ["line"])
    gone = gone.groupBy("row").agg(F.sum("words").alias("gone"), F.collect_set("hash").alias("common_lines"))
    out = kept.join(gone, "row", "left").withColumn("n_common_words", F.coalesce("gone", F.lit(0).cast("bigint")))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (F.col("n_common_words") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return out.withColumns({"base_failed": F.col("failed"), "kept": ~F.col("failed") & ~depleted})


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """(id, the counts, base_failed, kept, n_common_words) of every document."""
    rows = docs.select(col(id_col).alias("id"), col(host_col).cast("string").alias("host"), col(text_col).alias("text"))
    out = judged(rows, **limits)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def accepted(docs: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """The documents that are kept, with all their columns; common lines are taken out of their texts.

    ``length_col``, if there is such a column, is set to the new length where a text has changed. Verdicts travel by two
    hashes of the whole row, so the texts are shuffled once.
    """
    one, two, gone = (fresh(docs, name) for name in ("row_key_1", "row_key_2", "gone_lines"))
    columns = [col(c) for c in docs.columns]
    keyed = docs.withColumns({one: F.xxhash64(*columns), two: F.xxhash64(F.lit("second"), *columns)})
    rows = keyed.select(col(one).alias("one"), col(two).alias("two"), col(host_col).cast("string").alias("host"), col(text_col).alias("text"))
    kept = judged(rows, **limits).where("kept").select("one", "two", "common_lines").dropDuplicates(["one", "two"])
    kept = materialise(kept).select(F.col("one").alias(one), F.col("two").alias(two), F.col("common_lines").alias(gone))
    left = keyed.join(kept.hint("merge"), [one, two])
    rest = [c for c in docs.columns if c != text_col]
    names = [f"c{i}" for i in range(len(rest))]
    moved = left.select(*[col(c).alias(n) for c, n in zip(rest, names)], col(gone).alias("gone"), col(text_col).alias("text"))
    out = _without_lines(moved)
    size = F.length("text").cast(docs.schema[length_col].dataType) if length_col in rest else None
    back = {c: F.col(n) for c, n in zip(rest, names)} | {text_col: F.col("text")}
    if size is not None:
        back[length_col] = F.when(F.col("gone").isNotNull(), size).otherwise(back[length_col])
    return out.select(*[back[c].alias(c) for c in docs.columns])


def _without_lines(rows: DataFrame) -> DataFrame:
    """Rows (columns, gone, text), with the lines whose hashes are in gone taken out of the text."""

    def batches(batch_rows):
        for batch in batch_rows:
            at = len(batch.schema.names) - 1
            lists = batch.column(at - 1)
            if lists.null_count < len(lists):
                texts, gone = strings_of(batch.column(at)), lists.to_pylist()
                texts = [_stripped(t, set(g)) if g and t else t for t, g in zip(texts, gone)]
                batch = batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.column(at).type))
            yield batch

    return rows.mapInArrow(batches, rows.schema)


def _stripped(text: str, gone: set[int]) -> str:
    lines = text.split("\n")
    plain = [normalised(x.encode()) for x in lines]
    raw = b" ".join(plain)
    sizes = np.array([len(p) for p in plain], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    codes = span_codes(prefix_codes(np.frombuffer(raw + b" ", dtype=np.uint8)), ends - sizes, ends).view(np.int64)
    return "\n".join(x for x, c, p in zip(lines, codes.tolist(), plain) if not (p and c in gone))

"""Benchmark decontamination by Wu-Manber search over words.

Texts and test strings are sequences of words (A-Z lower-cased, runs of digits, letters a-z and non-ASCII characters).
A test string is a window of ``width`` consecutive words of a benchmark item, or the whole item if it has fewer. Windows
of one length m form a table: each block of two words gives the distance from its last place in any window to the
window's end, and a block that stands in no window allows a shift of m - 1 words, so most places of a text are never
looked at. Where the shift is zero, the window's last and first block select a bucket of windows; their words' hashes
and then the words themselves are compared. Places are searched side by side, in stretches of a text, but each stretch
moves by its own shifts.

Windows go to the executors in tables of at most ``TABLE_WINDOWS`` windows (their size is counted while they are read);
a larger benchmark gives several tables, which a task loads one after another, so memory is bounded. Documents are not
shuffled.

A null or empty text has no words and is clean. Null or empty items have no windows. An item id that stands for several
rows counts once; a null item id marks words as hit but is not listed. Repeated documents each get their own row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import ALNUM, Words, by_slice, col, mixed, prefix_codes, slices, span_codes, sums, texts_of
from titlekit.session import spread

WIDTH = 10
TABLE_WINDOWS = 200_000
STRETCH = 128
PAIRS_AT_ONCE = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    """Windows as words joined by blanks; a short item is one window."""
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def word_codes(words: list[bytes]) -> np.ndarray:
    raw = b" " + b" ".join(words) + b" "
    ends = 1 + np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    return span_codes(prefix_codes(np.frombuffer(raw, dtype=np.uint8)), starts, ends)


def block(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(3) + second)


class Table:
    """Shift table and buckets of the windows of one length."""

    def __init__(self, windows: list[bytes], owners: list[list[int]]):
        parts = [w.split(b" ") for w in windows]
        self.m = len(parts[0])
        self.size = min(2, self.m)
        codes = word_codes([w for p in parts for w in p]).reshape(-1, self.m)
        self.bits = np.uint64(64 - max(12, int(4 * len(windows) * self.m).bit_length()))
        self.shift = np.full(1 << (64 - int(self.bits)), self.m - self.size + 1, dtype=np.int16)
        for j in range(self.size - 1, self.m):
            np.minimum.at(self.shift, self._block(codes, j) >> self.bits, self.m - 1 - j)
        bucket = self._bucket(codes)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.codes = bucket[order], codes[order]
        self.windows = [windows[i] for i in order]
        self.owner_first = np.concatenate(([0], np.cumsum([len(owners[i]) for i in order])))
        self.owners = np.array([o for i in order for o in owners[i]], dtype=np.int64)

    def _block(self, codes: np.ndarray, j: int) -> np.ndarray:
        return codes[:, j] if self.size == 1 else block(codes[:, j - 1], codes[:, j])

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        return block(self._block(codes, self.m - 1), self._block(codes, self.size - 1))

    def ends(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places, by number of a window's last word, where the shift is zero."""
        counts = np.diff(first) - self.m + 1
        own = np.flatnonzero(counts > 0)
        if not len(own):
            return own
        stretches = (counts[own] + STRETCH - 1) // STRETCH
        begin = np.repeat(first[own] + self.m - 1, stretches)
        number = np.arange(len(begin)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = begin + number * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(first[own + 1], stretches))
        found = []
        while len(at):
            code = codes[at] if self.size == 1 else block(codes[at - 1], codes[at])
            step = self.shift[code >> self.bits]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return np.concatenate(found)

    def matches(self, words: Words, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the first word, number of the window) of every occurrence, compared word by word."""
        ends = self.ends(codes, words.first)
        for start in range(0, len(ends), PAIRS_AT_ONCE):
            begin = ends[start : start + PAIRS_AT_ONCE] - self.m + 1
            inside = codes[begin[:, None] + np.arange(self.m)]
            bucket = self._bucket(inside)
            low, high = np.searchsorted(self.bucket, bucket, "left"), np.searchsorted(self.bucket, bucket, "right")
            for step in range(int((high - low).max(initial=0))):
                held = np.flatnonzero(low + step < high)
                window = low[held] + step
                same = held[(self.codes[window] == inside[held]).all(axis=1)]
                sure = [k for k in same.tolist() if self._equal(words, int(begin[k]), int(low[k]) + step)]
                if sure:
                    yield begin[sure], low[sure] + step

    def _equal(self, words: Words, first: int, window: int) -> bool:
        starts, ends = words.starts[first : first + self.m].tolist(), words.ends[first : first + self.m].tolist()
        return b" ".join([words.buffer[s:e] for s, e in zip(starts, ends)]) == self.windows[window]


def tables_of(items: list[tuple[str | None, bytes]], width: int) -> tuple[list[str | None], list[Table]]:
    """Names of the items, and a table for each length of window."""
    names: list[str | None] = []
    number: dict[str | None, int] = {}
    owners: dict[bytes, dict[int, None]] = {}
    for name, text in items:
        if name not in number:
            number[name] = len(names)
            names.append(name)
        for window in windows_of(words_of(text), width):
            owners.setdefault(window, {})[number[name]] = None
    by_length: dict[int, list[bytes]] = {}
    for window in owners:
        by_length.setdefault(window.count(b" ") + 1, []).append(window)
    return names, [Table(own, [list(owners[w]) for w in own]) for _, own in sorted(by_length.items())]


def blocks(items: DataFrame, id_col: str, text_col: str, width: int, most: int) -> Iterator[tuple[list, list[Table]]]:
    """Tables of at most ``most`` windows (but a whole item), read part by part."""
    rows = items.select(col(id_col).cast("string").alias("i"), col(text_col).alias("t")).where("t IS NOT NULL")
    some, count = [], 0
    for row in rows.toLocalIterator():
        some.append((row["i"], row["t"].encode()))
        count += max(1, len(words_of(some[-1][1])))
        if count >= most:
            yield tables_of(some, width)
            some, count = [], 0
    if some:
        yield tables_of(some, width)


def tables_sent(items: DataFrame, item_col: str, item_text_col: str, width: int, table_windows: int) -> list:
    """The items' tables as broadcasts, each of a bounded number of windows."""
    context = items.sparkSession.sparkContext
    return [context.broadcast(b) for b in blocks(items, item_col, item_text_col, width, table_windows)]


def search(texts: list[bytes], sent: list) -> tuple[Words, np.ndarray, list[set[str | None]]]:
    """The texts' words, which of them are hit, and the items found in each text."""
    words = Words([t.lower() for t in texts], ALNUM)
    codes = words.codes()
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    found: list[set[str | None]] = [set() for _ in texts]
    for each in sent:
        names, tables = each.value
        for t in tables:
            for begin, window in t.matches(words, codes):
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + t.m, -1)
                text = np.searchsorted(words.first, begin, "right") - 1
                for i, w in set(zip(text.tolist(), window.tolist())):
                    found[i].update(names[o] for o in t.owners[t.owner_first[w] : t.owner_first[w + 1]].tolist())
        if len(sent) > 1:
            each.__dict__.pop("_value", None)  # one table at a time in memory; it is read again from the local copy
    return words, np.cumsum(covered[:-1]) > 0, found


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = WIDTH, table_windows: int = TABLE_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document, and the list of items found."""
    sent = tables_sent(items, item_col, item_text_col, width, table_windows)

    def find(texts: list[bytes]) -> list:
        words, hit, found = search(texts, sent)
        lists = [sorted(x for x in f if x is not None) for f in found]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        return [words.counts.astype(np.int64), sums(hit, words.first), sizes, digests, pa.array(lists, pa.list_(pa.string()))]

    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    out = by_slice(rows, find, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", width: int = WIDTH, table_windows: int = TABLE_WINDOWS) -> DataFrame:
    """The documents without any hit word, with all their columns. Nothing is shuffled."""
    sent = tables_sent(items, item_col, item_text_col, width, table_windows)
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(place))
            for a, b in slices(texts):
                words, hit, _ = search(texts[a:b], sent)
                yield batch.slice(a, b - a).filter(pa.array(sums(hit, words.first) == 0))

    return spread(docs).mapInArrow(clean, docs.schema)

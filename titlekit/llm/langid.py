"""Language by the nearest of several centroids for each language.

A text is a vector of the n-grams (two and three bytes of lower-case UTF-8, everything but letters as one blank) hashed
into ``BUCKETS``, with logarithmic counts, inverse document frequency, and length 1. Document frequencies are counted over
all rows that may be learned from. The centroids of a language come from spherical k-means over a bounded sample of its
rows (``SAMPLE_ROWS`` of each language, ``SAMPLE_BYTES`` of text). A text gets the language of the centroid with the
largest cosine. A text farther from its centroid than nearly all of the sample's texts from theirs is marked as rejected:
it is probably in none of the languages.

Scoring reads every whole text once, by slices, and shuffles nothing. A null text and one without a letter are ``und``
with score 0, and so is every text if there is nothing to learn from. Repeated rows get equal answers; an empty table
gives an empty result; extra columns are ignored; bytes that are not UTF-8 are no letters. Nulls in the language are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import as_text, by_slice, col, held_out, labelled_sample, learnable, slices, texts_of
from titlekit.session import spread

SAMPLE_ROWS = 600
SAMPLE_BYTES = 16 << 20
BUCKETS = 1 << 13
CENTROIDS = 3
ROUNDS = 15
SHARPNESS = 30.0
FAR_SHARE = 0.002
FAR_FACTOR = 0.6
TEXTS_AT_ONCE = 256
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])
UNKNOWN = "und"


def counts(texts: list[bytes]) -> np.ndarray:
    """How often each text has the n-grams of each bucket."""
    lowered = [as_text(t).lower().encode() for t in texts]
    raw = np.frombuffer(b"  " + b"  ".join(lowered) + b"  ", dtype=np.uint8)
    raw = np.where(NOT_LETTERS[raw], 32, raw).astype(np.uint32)
    sizes = np.array([len(t) for t in lowered])
    ends = 2 + np.cumsum(sizes + 2) - 2
    owner = np.repeat(np.arange(len(texts)), sizes + 2)[: len(raw) - 2]
    two = raw[:-2] * 257 + raw[1:-1]
    three = two * 263 + raw[2:]
    inside = (raw[1:-1] != 32) & (np.arange(len(raw) - 2) < np.repeat(ends, sizes + 2)[: len(raw) - 2])
    out = np.zeros(len(texts) * BUCKETS, dtype=np.float32)
    for gram, salt in ((two, 1), (three, 2)):
        bucket = ((gram[inside] * np.uint32(2654435769) + np.uint32(salt * 40503)) >> np.uint32(32 - 13)).astype(np.int64)
        out += np.bincount(owner[inside] * BUCKETS + bucket, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), BUCKETS)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def in_batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``TEXTS_AT_ONCE`` texts, and of a slice's bytes."""
    for a, b in slices(texts):
        for c in range(a, b, TEXTS_AT_ONCE):
            yield c, min(b, c + TEXTS_AT_ONCE)


def frequencies(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[int, np.ndarray]:
    """In how many texts that may be learned from each bucket occurs; one row of sums for each task."""
    rows = docs.where(learnable(id_col) & col(lang_col).isNotNull() & col(text_col).isNotNull()).select(col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in in_batches(texts):
                total += (counts(texts[a:b]) > 0).sum(axis=0)
                seen += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(total, seen))], names=["bucket", "n"])

    summed = spread(rows).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in summed:
        out[r["bucket"]] = r["n"]
    return int(out[-1]), out[:-1]


class Centroids:
    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.idf, self.names, self.centres, self.owner, self.least = idf, names, centres, owner, least

    def nearest(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cosine, rejected) of each text."""
        n = len(texts)
        langs, score, cosine, far = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        if not self.names:
            return langs, score, cosine, far
        for a, b in in_batches(texts):
            near = vectors(texts[a:b], self.idf) @ self.centres.T
            best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.names))], axis=1)
            weight = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            pick = best.argmax(axis=1)
            own = np.arange(b - a)
            cosine[a:b] = best[own, pick]
            score[a:b] = 1 / weight.sum(axis=1)
            far[a:b] = cosine[a:b] < self.least[pick]
            for i in own:
                if LETTER.search(as_text(texts[a + i])):
                    langs[a + i] = self.names[pick[i]]
                else:
                    score[a + i], cosine[a + i], far[a + i] = 0.0, 0.0, True
        return langs, score, cosine, far


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from texts far from each other; fewer centroids if there are fewer texts."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        moved = np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: list[tuple[bytes, str, float]], texts_seen: int, frequency: np.ndarray) -> Centroids:
    idf = (np.log((1 + texts_seen) / (1 + frequency)) + 1).astype(np.float32)
    names = sorted({y for _, y, _ in sample})
    centres, owner, least = [], [], []
    for k, name in enumerate(names):
        texts = [t for t, y, _ in sample if y == name and LETTER.search(as_text(t))]
        if not texts:
            continue
        x = np.concatenate([vectors(texts[a:b], idf) for a, b in in_batches(texts)])
        own = clustered(x, CENTROIDS)
        centres.append(own)
        owner += [name] * len(own)
        least.append((name, FAR_FACTOR * float(np.quantile((x @ own.T).max(axis=1), FAR_SHARE))))
    names = [n for n, _ in least]
    place = {n: k for k, n in enumerate(names)}
    return Centroids(idf, names, np.concatenate(centres) if centres else np.zeros((0, BUCKETS)), np.array([place[o] for o in owner]), np.array([v for _, v in least]))


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, held_out, lang_pred, score, cosine, rejected) of every document."""
    known = docs.select(col(id_col).alias(id_col), col(lang_col).alias(lang_col), col(text_col).alias(text_col))
    sample = labelled_sample(known, known.where(col(text_col).isNotNull()), lang_col, id_col, text_col, sample_rows, sample_bytes)
    model = fit(sample, *frequencies(known, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of BUCKETS numbers for each language
    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    out = by_slice(rows, lambda texts: list(sent.value.nearest(texts)), "lang_pred string, score double, cosine double, rejected boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "cosine", "rejected")

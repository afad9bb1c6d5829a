"""Toxicity by a factorization machine over hashed terms.

Terms are words (Unicode lower case) and their beginnings, hashed into 2 ** 18 buckets; a text has a term or not. The
score's logit is a bias, a weight for each term, and for each pair of terms the inner product of their factors, so an
insult beside the mention of a group can weigh more than the two apart. The sum over pairs takes time linear in the
terms.

The model is fitted on the driver from a bounded sample (``SAMPLE_ROWS`` of each class, ``SAMPLE_BYTES`` of text) of
labelled rows that are not held out. Every bucket that occurs there has a weight and factors; none is left out. How fast
they move is regularised: a weight by how far its term's share differs between the classes (in variances, so a word in
few rows moves less, and a word alike in both least), factors by how often their term occurs, both by decay. A row's step
is divided by the sum of its terms' rates, so a long text does not move more than a short one. Scoring reads every whole
text once, by slices, and shuffles nothing.

A null or empty text has no terms and gets the bias. Without labelled rows of both classes every score is the share of
label 1 (0 if there are no labels). Repeated rows get equal scores; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import ALNUM, Words, as_text, by_slice, col, held_out, labelled_sample, mixed, prefix_codes, slices, span_codes
from titlekit.session import spread

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 32 << 20
BITS = 18
BEGINNINGS = (3, 4, 5, 6)
FACTORS = 8
EPOCHS = 12
BATCH = 16
#: Rates of weights and factors, decay; variances and rows at which a term has half its rate; least rate of a weight.
WEIGHT_RATE = 2.0
FACTOR_RATE = 0.2
DECAY = 1e-4
HALF_VARIANCES = 16.0
HALF_ROWS = 200.0
LEAST_RATE = 0.002
THRESHOLD = 0.5


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term, repeats included."""
    words = Words([as_text(t).lower().encode() for t in texts], ALNUM)
    prefix = prefix_codes(words.raw)
    owner = words.owner()
    owners, codes = [owner], [span_codes(prefix, words.starts, words.ends)]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.ends - words.starts > n)
        owners.append(owner[long])
        codes.append(mixed(span_codes(prefix, words.starts[long], words.starts[long] + n) + np.uint64(n)))
    return np.concatenate(owners), (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_terms(texts: list[bytes], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) without repeats, ordered; with ``place`` only the model's terms, by their number in it."""
    owner, bucket = terms(texts)
    if place is not None:
        bucket = place[bucket]
        owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
    keys = np.unique(owner << 32 | bucket)
    return keys >> 32, keys & 0xFFFFFFFF


class Machine:
    """A fitted machine: bias, the number of each bucket's term or -1, weights and factors."""

    def __init__(self, bias: float, place: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.place, self.weights, self.factors = bias, place, weights, factors

    def logits(self, n: int, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
        """``owner`` is in order."""
        linear = np.bincount(owner, self.weights[term], minlength=n)
        total = np.zeros((n, self.factors.shape[1]))
        for f in range(self.factors.shape[1]):
            total[:, f] = np.bincount(owner, self.factors[term, f], minlength=n)
        square = np.bincount(owner, (self.factors * self.factors).sum(axis=1)[term], minlength=n)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - square)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, term = distinct_terms(texts, self.place)
        return 1 / (1 + np.exp(-np.clip(self.logits(len(texts), owner, term), -40, 40)))


def fit(sample: list[tuple[bytes, int, float]]) -> Machine:
    """Logistic loss in small batches, both classes weighing the same; the bias then gets the classes' true shares."""
    texts = [t for t, _, _ in sample]
    y = np.array([float(label > 0) for _, label, _ in sample])
    weight = np.array([w for _, _, w in sample])
    place = np.full(1 << BITS, -1, dtype=np.int64)
    prior = float((weight * y).sum() / weight.sum()) if len(sample) else 0.0
    if not 0 < prior < 1:
        return Machine(40.0 if prior else -40.0, place, np.zeros(0), np.zeros((0, FACTORS)))
    n = len(y)
    owners, buckets = [], []
    for a, b in slices(texts):
        owner, bucket = distinct_terms(texts[a:b])
        owners.append((owner + a).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    own = np.flatnonzero(np.bincount(bucket, minlength=1 << BITS))
    place[own] = np.arange(len(own))
    term = place[bucket].astype(np.int32)

    # how far the shares of a term in the two classes are apart, in variances of chance
    ones, zeros = y.sum(), (1 - y).sum()
    with_one = np.bincount(term, y[owner], minlength=len(own))
    with_zero = np.bincount(term, 1 - y[owner], minlength=len(own))
    share = (with_one + with_zero + 1) / (ones + zeros + 2)
    apart = (with_one / ones - with_zero / zeros) ** 2 / (share * (1 - share) * (1 / ones + 1 / zeros))
    rate_of_weight = LEAST_RATE + apart**3 / (apart**3 + HALF_VARIANCES**3)
    rate_of_factor = (with_one + with_zero) / (with_one + with_zero + HALF_ROWS)
    all_weights = np.maximum(np.bincount(owner, rate_of_weight[term], minlength=n), 1)
    all_factors = np.maximum(np.bincount(owner, rate_of_factor[term], minlength=n), 1)

    random = np.random.default_rng(7)
    model = Machine(0.0, place, np.zeros(len(own)), random.normal(0, 0.02, (len(own), FACTORS)))
    balance = 0.5 * np.where(y > 0, n / ones, n / zeros)
    order = random.permutation(n)
    first = np.searchsorted(owner, np.arange(n + 1))
    batches = []
    for a in range(0, n, BATCH):
        rows = order[a : a + BATCH]
        mine, local = np.unique(np.concatenate([term[first[r] : first[r + 1]] for r in rows]), return_inverse=True)
        batches.append((rows, np.repeat(np.arange(len(rows)), np.diff(first)[rows]).astype(np.int32), mine, local.astype(np.int32)))
    for epoch in range(EPOCHS):
        pace = min(1.0, 2 * (1 - epoch / EPOCHS))
        for k in random.permutation(len(batches)):
            rows, row, mine, local = batches[k]
            m = len(rows)
            part = Machine(model.bias, place, model.weights[mine], model.factors[mine])
            p = 1 / (1 + np.exp(-np.clip(part.logits(m, row, local), -40, 40)))
            error = balance[rows] * (p - y[rows])
            step = np.bincount(local, (error / all_weights[rows])[row], minlength=len(mine)) * rate_of_weight[mine]
            model.weights[mine] -= pace * WEIGHT_RATE * (step + DECAY * part.weights)
            v = part.factors[local]
            total = np.stack([np.bincount(row, v[:, f], minlength=m) for f in range(FACTORS)], axis=1)
            push = (error / (all_factors[rows] * (1 + (total * total).sum(axis=1))))[row]
            for f in range(FACTORS):
                step = np.bincount(local, push * (total[row, f] - v[:, f]), minlength=len(mine)) * rate_of_factor[mine]
                model.factors[mine, f] -= pace * (FACTOR_RATE * step + WEIGHT_RATE * DECAY * part.factors[:, f])
            model.bias -= float(0.05 * pace * WEIGHT_RATE * error.mean())
    model.bias += float(np.log(prior / (1 - prior)))
    return model


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
           sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, held_out, score, predicted) of every document; learned from the labelled rows that are not held out."""
    labels = labels.select(col(id_col).alias(id_col), col(label_col).cast("int").alias(label_col))
    model = fit(labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows, sample_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 18 places, weights and factors at most
    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    out = by_slice(rows, lambda texts: [sent.value.scores(texts)], "score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

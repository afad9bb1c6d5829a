"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of its neighbours (the line before and the one after). A chain over
the lines of a text labels each of them good or bad; forward and backward messages give each line's marginal, and a
text's quality is the mean marginal weighted by the lines' lengths, put on a probability scale by a logistic curve.

The field is fitted on the driver from a bounded sample (``SAMPLE_ROWS`` of each class, ``SAMPLE_BYTES`` of text) of
labelled rows that are not held out: a line has its text's label, lines weigh by length, classes weigh as in all labels.
Chains longer than ``TRAIN_LINES`` are cut for fitting, never for scoring. Scoring reads every whole text once, by
slices, in lockstep over the lines of many texts, and shuffles nothing.

A null text, an empty one, and one without any word have no lines and the score 0. Without labelled rows of both classes
every other score is the share of label 1 (0 if there are no labels). Repeated rows get equal scores; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import SPACED, Words, by_slice, byte_set, col, held_out, labelled_sample, mixed, slices
from titlekit.session import spread

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 12 << 20
TRAIN_LINES = 64
STEPS = 200
THRESHOLD = 0.3

#: Kinds of bytes whose share in a line is a feature.
KINDS = [byte_set(p) for p in (r"[A-Z]", r"[0-9]", r"[#*$%&<>=_{}\\^~]", r"[|]", r"[!?]", r"[.,;:]", r"[()\[\]'\"/@+-]", r"[\x80-\xff]", r"[\x00-\x08\x0e-\x1f\x7f]")]


class Lines:
    """The lines with a word of several texts: features, lengths in bytes of words, and each text's first line."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, SPACED)
        raw, n = words.raw, len(words.starts)
        breaks = np.flatnonzero(raw == 10)
        # a line starts where the text or the count of line breaks before a word changes
        line = np.searchsorted(breaks, words.starts)
        owner = words.owner()
        new = np.ones(n, dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.count = len(first)
        edge = np.append(first, n)
        self.owner = owner[first]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        if not self.count:
            self.features, self.lengths = np.zeros((0, 0)), np.zeros(0)
            return
        begin, end = words.starts[first], words.ends[edge[1:] - 1]
        sizes = words.ends - words.starts
        self.lengths = np.add.reduceat(sizes, first).astype(np.float64)
        count = np.diff(edge).astype(np.float64)
        own = [np.log1p(self.lengths), np.log1p(count), self.lengths / count]
        for kind in KINDS:
            total = np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int32)))
            own.append((total[end] - total[begin]) / self.lengths)
        codes = words.codes()
        number = np.repeat(np.arange(self.count), np.diff(edge))
        # distinct words by line: a hash of line and word counts at one of its places
        keys = mixed(codes + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        ordered_keys = keys[order]
        once = np.ones(n, dtype=bool)
        once[1:] = ordered_keys[1:] != ordered_keys[:-1]
        own.append(np.bincount(number[order[once]], minlength=self.count) / count)
        same = np.zeros(n)
        same[1:] = (codes[1:] == codes[:-1]) & ~new[1:]
        own.append(np.add.reduceat(same, first) / count)
        content = mixed(np.add.reduceat(codes * (2 * np.arange(n, dtype=np.uint64) + np.uint64(1) - 2 * np.repeat(first, np.diff(edge)).astype(np.uint64)), first))
        again = np.zeros(self.count)
        ordered = np.lexsort((np.arange(self.count), content, self.owner))
        equal = (content[ordered][1:] == content[ordered][:-1]) & (self.owner[ordered][1:] == self.owner[ordered][:-1])
        again[ordered[1:][equal]] = 1
        own.append(again)
        closes = np.isin(raw[end - 1], np.frombuffer(b".!?:;", dtype=np.uint8))
        opens = (raw[begin] >= 65) & (raw[begin] <= 90)
        own += [closes.astype(np.float64), opens.astype(np.float64)]
        mine = np.stack(own, axis=1)
        before, after = np.zeros_like(mine), np.zeros_like(mine)
        joined = self.owner[1:] == self.owner[:-1]
        before[1:][joined] = mine[:-1][joined]
        after[:-1][joined] = mine[1:][joined]
        ends = np.ones((self.count, 2))
        ends[1:, 0], ends[:-1, 1] = ~joined, ~joined
        self.features = np.concatenate((mine, before, after, ends), axis=1)


def marginals(scores: np.ndarray, first: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at every line, and expected pairs of labels (2 x 2, by text) along the chains.

    ``scores`` is the logit of label 1 at each line, ``change`` the weights of label pairs. Messages run through many
    texts at once, one line further in each step.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes_in_order = first[:-1][order], sizes[order]
    longest = int(sizes_in_order[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes_in_order, -np.arange(1, longest + 1), "right")
    local = np.stack((np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))), axis=1)
    local /= local.sum(axis=1, keepdims=True)
    step = np.exp(change)
    forward, backward = np.empty_like(local), np.ones_like(local)
    for t in range(longest):
        at = begin[: active[t]] + t
        message = local[at] if t == 0 else (forward[at - 1] @ step) * local[at]
        forward[at] = message / message.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        message = (backward[at + 1] * local[at + 1]) @ step.T
        backward[at] = message / message.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(len(scores), dtype=bool)
    inner[first[:-1][sizes > 0]] = False
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] * step[None] * (local[at] * backward[at])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pairs


class Field:
    """A fitted field, and the curve from mean marginals to probabilities."""

    def __init__(self, middle, spread_of, weights, change, curve, constant=None):
        self.middle, self.spread, self.weights, self.change, self.curve, self.constant = middle, spread_of, weights, change, curve, constant

    def mean(self, lines: Lines) -> np.ndarray:
        scores = ((lines.features - self.middle) / self.spread) @ self.weights[:-1] + self.weights[-1]
        good, _ = marginals(scores, lines.first, self.change)
        n = len(lines.first) - 1
        total = np.bincount(lines.owner, lines.lengths, minlength=n)
        return np.bincount(lines.owner, lines.lengths * good, minlength=n) / np.maximum(total, 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        lines = Lines(texts)
        has = np.diff(lines.first) > 0
        if self.constant is not None or not lines.count:
            return np.where(has, self.constant or 0.0, 0.0)
        return np.where(has, curve_of(self.mean(lines), self.curve), 0.0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def curve_of(p: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * logit(p) + curve[1], -40, 40)))


def fit(sample: list[tuple[bytes, int, float]]) -> Field:
    """Weighted conditional likelihood of the lines' labels, Adam over full batches; then the curve over the texts."""
    labels = np.array([float(y > 0) for _, y, _ in sample])
    weight = np.array([w for _, _, w in sample])
    prior = float((labels * weight).sum() / weight.sum()) if len(sample) else 0.0
    if not 0 < prior < 1:
        return Field(0, 1, np.zeros(1), np.zeros((2, 2)), (1.0, 0.0), prior)
    texts = [t for t, _, _ in sample]
    groups = [Lines(texts[a:b]) for a, b in slices(texts)]
    starts = np.cumsum([0] + [len(g.first) - 1 for g in groups])
    groups = [(g, s) for g, s in zip(groups, starts) if g.count]
    if not groups:
        return Field(0, 1, np.zeros(1), np.zeros((2, 2)), (1.0, 0.0), prior)
    features = np.concatenate([g.features for g, _ in groups])
    owner = np.concatenate([g.owner + s for g, s in groups])
    lengths = np.concatenate([g.lengths for g, _ in groups])
    middle, spread_of = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.concatenate(((features - middle) / spread_of, np.ones((len(features), 1))), axis=1)
    y = labels[owner]
    # chains: the lines of a text, cut after TRAIN_LINES
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    first = np.flatnonzero(place % TRAIN_LINES == 0)
    bounds = np.append(first, len(owner))
    # a chain weighs by its text, and its lines share that weight by length
    text_lengths = np.bincount(owner, lengths, minlength=len(sample))
    of_line = weight[owner] * lengths / np.maximum(text_lengths[owner], 1)
    of_line /= of_line.sum()
    inner = np.ones(len(owner), dtype=bool)
    inner[first] = False
    pair_of = np.flatnonzero(inner)
    real = np.zeros((2, 2))
    np.add.at(real, (y[pair_of - 1].astype(int), y[pair_of].astype(int)), of_line[pair_of])
    weights, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(weights), np.zeros_like(change)]
    s = [np.zeros_like(weights), np.zeros_like(change)]
    for step in range(1, STEPS + 1):
        good, pairs = marginals(x @ weights, bounds, change)
        gradients = [x.T @ (of_line * (good - y)) + 1e-4 * weights, (of_line[pair_of, None, None] * pairs).sum(axis=0) - real + 1e-2 * change]
        rate = 0.1 if step < STEPS // 2 else 0.03
        for i, g in enumerate(gradients):
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
            moved = rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                weights = weights - moved
            else:
                change = change - moved
    field = Field(middle, spread_of, weights, change, (1.0, 0.0))
    means = np.concatenate([field.mean(g) for g, _ in groups])
    known = np.concatenate([np.arange(s, s + len(g.first) - 1) for g, s in groups])
    seen = np.concatenate([np.diff(g.first) > 0 for g, _ in groups])
    field.curve = fit_curve(logit(means[seen]), labels[known[seen]], weight[known[seen]])
    return field


def fit_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a little shrinkage."""
    weight = weight / weight.sum()
    x = np.stack((z, np.ones_like(z)), axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * (beta - np.array([1.0, 0.0]))
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(curvature, gradient), -1, 1)
    return float(max(beta[0], 0.0)), float(beta[1])


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, held_out, score, predicted) of every document; learned from the labelled rows that are not held out."""
    labels = labels.select(col(id_col).alias(id_col), col(label_col).cast("int").alias(label_col))
    field = fit(labelled_sample(docs, labels, label_col, id_col, text_col, sample_rows, sample_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    rows = spread(docs.select(col(id_col).alias("id"), col(text_col).alias("text")))
    out = by_slice(rows, lambda texts: [sent.value.scores(texts)], "score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

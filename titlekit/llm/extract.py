"""Main text of web pages by a tree-structured graphical model.

Each block of a page's tree is content or not. A block's features give it a potential, and each parent and child share a
potential that knows how often content lies in content. Messages pass from the leaves to the root and back (sum-product),
which gives every block its exact marginal; a page's text is that of the blocks that are more likely content than not.
The trees of many pages are worked through side by side, one level of depth at a time.

The weights are fitted on labelled pages, by likelihood: in ``labelled_pages`` blocks are marked with ``data-label``
("content" or "other", inherited inside); any list of pages so marked can be given. Pages are read whole, one by one, in
linear time; nothing is shuffled.

A null, empty or text-free page has the empty text. Repeated pages get equal texts; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.llm.common import as_text, by_slice, col
from titlekit.llm.dom import Page
from titlekit.llm.labelled_pages import labelled_pages
from titlekit.session import spread

STEPS = 250
SHRINK = 3e-4
FAR = 3.0


def levels(parent: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """Blocks by depth, from 1 on."""
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    return [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def beliefs(scores: np.ndarray, parent: np.ndarray, depth: np.ndarray, bond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of content for each block, and of (parent, child) labels for each block below a root.

    ``scores`` are the logits of content, ``bond[parent label, child label]`` the logarithm of the shared potential.
    """
    local = np.stack((np.zeros_like(scores), scores), axis=1)
    steps = levels(parent, depth)
    up = np.zeros_like(local)  # message of each block to its parent
    inside = local.copy()  # own potential and messages from below
    for own in reversed(steps):
        message = log_sum(inside[own][:, None, :] + bond[None])
        up[own] = message - message.max(axis=1, keepdims=True)
        np.add.at(inside, parent[own], up[own])
    down = np.zeros_like(local)
    for own in steps:
        outside = inside[parent[own]] + down[parent[own]] - up[own]
        message = log_sum((outside[:, :, None] + bond[None]).transpose(0, 2, 1))
        down[own] = message - message.max(axis=1, keepdims=True)
    total = inside + down
    total -= log_sum(total)[:, None]
    pairs = np.zeros((len(scores), 2, 2))
    own = np.flatnonzero(parent >= 0)
    joint = (inside[parent[own]] + down[parent[own]] - up[own])[:, :, None] + bond[None] + inside[own][:, None, :]
    joint = joint.reshape(-1, 4)
    pairs[own] = np.exp(joint - log_sum(joint)[:, None]).reshape(-1, 2, 2)
    return np.exp(total[:, 1]), pairs


class Trees:
    """The blocks of several pages, one page after the other."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + s, -1) for p, s in zip(pages, self.first)])
        self.depth = np.concatenate([np.array(p.depth) for p in pages])
        self.features = np.concatenate([p.measures() for p in pages])


def scaled(features: np.ndarray, middle: np.ndarray, spread_of: np.ndarray) -> np.ndarray:
    """Standard deviations from the middle, at most FAR, so that no single measure decides on a block."""
    return np.clip((features - middle) / spread_of, -FAR, FAR)


class Extractor:
    def __init__(self, middle: np.ndarray, spread_of: np.ndarray, weights: np.ndarray, bond: np.ndarray):
        self.middle, self.spread, self.weights, self.bond = middle, spread_of, weights, bond

    def marginals(self, trees: Trees) -> np.ndarray:
        scores = scaled(trees.features, self.middle, self.spread) @ self.weights[:-1] + self.weights[-1]
        return beliefs(scores, trees.parent, trees.depth, self.bond)[0]

    def texts(self, pages: list[str]) -> list[str]:
        read = [Page(p) for p in pages]
        trees = Trees(read)
        keep = self.marginals(trees) > 0.5
        return [p.text(keep[a:b]) for p, a, b in zip(read, trees.first[:-1], trees.first[1:])]


def labels_of(page: Page) -> np.ndarray:
    out = np.zeros(len(page.parent))
    for i, mark in enumerate(page.labels):
        out[i] = float(mark == "content") if mark else (out[page.parent[i]] if i else 0.0)
    return out


def fit(pages: list[str]) -> Extractor:
    """Conditional likelihood of the marked pages' labels with shrinkage, Adam over full batches."""
    read = [Page(p) for p in pages]
    trees = Trees(read)
    y = np.concatenate([labels_of(p) for p in read])
    middle, spread_of = trees.features.mean(axis=0), trees.features.std(axis=0) + 0.05
    x = np.concatenate((scaled(trees.features, middle, spread_of), np.ones((len(y), 1))), axis=1)
    own = np.flatnonzero(trees.parent >= 0)
    real = np.zeros((2, 2))
    np.add.at(real, (y[trees.parent[own]].astype(int), y[own].astype(int)), 1 / len(y))
    weights, bond = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(bond), np.zeros_like(bond)]]
    for step in range(1, STEPS + 1):
        content, pairs = beliefs(x @ weights, trees.parent, trees.depth, bond)
        gradients = [x.T @ (content - y) / len(y) + SHRINK * weights, pairs.sum(axis=0) / len(y) - real + SHRINK * bond]
        rate = 0.1 if step < STEPS // 2 else 0.03
        moves = []
        for (m, s), g in zip(state, gradients):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8))
        weights, bond = weights - moves[0], bond - moves[1]
    return Extractor(middle, spread_of, weights, bond)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    model = fit(labelled if labelled is not None else labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    rows = spread(pages.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).alias("html")))

    def texts(found: list[bytes]) -> list:
        out = sent.value.texts([as_text(p) for p in found])
        return [out, np.array([len(t) for t in out], dtype=np.int64)]

    out = by_slice(rows, texts, "text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

"""Vector columns as numpy blocks, and distances between them (KNN1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(df: DataFrame, col: str) -> Column:
    """A vector or numeric array column as ``array<double>``."""
    if isinstance(df.schema[col].dataType, VectorUDT):
        return vector_to_array(F.col(col))
    return F.col(col).cast("array<double>")


def euclidean(a, b) -> Column:
    """Distance of two array columns of one row."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


def block(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column to a rows x dimensions matrix; all rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    numbers = column.flatten()
    if numbers.null_count:
        raise ValueError("a vector holds a null")
    if rows:
        lengths = pc.min_max(pc.list_value_length(column))
        if lengths["min"] != lengths["max"]:
            raise ValueError("vectors differ in length")
    values = numbers.to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def squared_to(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Squared distance of every point to one pivot."""
    return ((points - pivot) ** 2).sum(axis=1)


# A chunk of the distance matrix never holds more than this many numbers.
CHUNK_CELLS = 2_000_000


def nearest_in_block(queries: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, max_distance: float,
                     bound: np.ndarray | None = None):
    """For each query the ``k`` nearest points by (distance, id).

    Returns (query row, point row, distance) arrays. A matrix product shortlists the points that can be among the
    nearest, with a margin above its rounding error; their distances are then taken directly, so equal vectors tie
    exactly and the ids decide. ``bound`` is a distance for each query beyond which no point is wanted any more.
    """
    found = ([], [], [])
    if len(queries) and len(points) and queries.shape[1] != points.shape[1]:
        raise ValueError("queries and training vectors differ in length")
    pairs_at_once = max(1, CHUNK_CELLS // max(1, queries.shape[1]))
    norms = (points**2).sum(axis=1)
    # where every pair is wanted a chunk has ids and distances of all of them, otherwise of few
    step = max(1, CHUNK_CELLS // (4 if len(points) > k else 8) // max(1, len(points)))
    if len(points) > k:
        # one product gives the squared distances less the queries' own squares, which do not change the order
        columns = np.vstack([-2.0 * points.T, norms])
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        if len(points) > k:
            rough = np.hstack([part, np.ones((len(part), 1))]) @ columns
            squares = (part**2).sum(axis=1)
            margin = 1e-9 * (squares + norms.max()) + 1e-300
            limit = np.full(len(part), np.inf) if bound is None else bound[start : start + step] ** 2 - squares
            near = None if bound is None else rough <= (limit + margin)[:, None]
            if near is None or np.count_nonzero(near) > 4 * k * len(part):
                limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                near = rough <= (limit + margin)[:, None]
            q, p = np.divmod(np.flatnonzero(near), len(points))
        else:
            q, p = np.divmod(np.arange(len(part) * len(points)), max(1, len(points)))
        distance = np.empty(len(q))
        for lo in range(0, len(q), pairs_at_once):
            hi = lo + pairs_at_once
            distance[lo:hi] = np.sqrt(((part[q[lo:hi]] - points[p[lo:hi]]) ** 2).sum(axis=1))
        near = distance <= max_distance
        q, p, distance = q[near], p[near], distance[near]
        order = np.lexsort((point_ids[p], distance, q))
        q, p, distance = q[order], p[order], distance[order]
        first = np.searchsorted(q, q, side="left")
        kept = np.arange(len(q)) - first < k
        found[0].append(q[kept] + start)
        found[1].append(p[kept])
        found[2].append(distance[kept])
    if not found[0]:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(f) for f in found)

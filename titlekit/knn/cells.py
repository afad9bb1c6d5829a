"""Training vectors cut into cells and bounded blocks (KNN3, KNN5, KNN6, PRT1, CCH1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlekit.knn.tau import SAMPLE_SIZES, estimate_tau
from titlekit.knn.tree import PivotTree
from titlekit.knn.vectors import as_doubles, block, squared_to
from titlekit.operators.sampling import sample_rows, unit_hash

# Bytes of vectors in a cell that is not split again, and that the driver may hold of a sample.
CELL_BYTES = 64 * 1024 * 1024
SAMPLE_BYTES = 256 * 1024 * 1024
# What a search task holds of each side, in bytes of vectors and in rows: a block of the training rows, a part of the queries.
BLOCK_BYTES = 8 * 1024 * 1024
MOST_BLOCK_ROWS = 1 << 14
SPLIT_POINTS = 100_000
# Bundles a core gets, unless they would have fewer rows than are worth a task's overhead.
BUNDLES_PER_CORE = 16
BUNDLE_ROWS = 128

CELL_TYPE = pa.list_(pa.struct([("cell_id", pa.int32()), ("centre_distance", pa.float64())]))


@dataclass
class CellIndex:
    """A fitted index: the routing tree, and the training rows with ``cell_id``, ``bundle`` and ``block``.

    A bundle is a run of neighbouring cells that one task searches; a cell too large for a task is a bundle of several
    blocks.
    """

    tree: PivotTree
    tau: float
    spill: str
    rows: DataFrame
    sizes: dict[int, int]
    radius: dict[int, float]
    bundle_of: np.ndarray
    blocks: dict[int, int]
    aux: tuple[str, ...]
    dimensions: int
    copies: int | None
    #: tau was estimated, not given
    estimated: bool = False

    def bundle_rows(self) -> dict[int, int]:
        """Training rows of each bundle."""
        total: dict[int, int] = {}
        for cell, size in self.sizes.items():
            bundle = int(self.bundle_of[cell])
            total[bundle] = total.get(bundle, 0) + size
        return total

    def release(self) -> None:
        """Drop the cached training rows."""
        self.rows.unpersist()


def bundled(sizes: dict[int, int], cells: int, rows: int) -> np.ndarray:
    """The bundle of each cell: runs of cells with at most ``rows`` training rows, larger cells alone."""
    bundle_of = np.zeros(cells, int)
    bundle = filled = 0
    for cell in range(cells):
        size = sizes.get(cell, 0)
        if filled and filled + size > rows:
            bundle, filled = bundle + 1, 0
        bundle_of[cell] = bundle
        filled += size
    return bundle_of


def router(tree: PivotTree, tau: float, side: str):
    """Arrow function: vectors to a list of (cell, distance to its centre)."""
    centres = np.array(tree.centres)

    @F.arrow_udf("array<struct<cell_id:int,centre_distance:double>>")
    def cells_of(features: pa.Array) -> pa.Array:
        points = block(features)
        row, cell = tree.route(points, tau, side)
        order = np.lexsort((cell, row))
        row, cell = row[order], cell[order]
        if len(row):
            distance = np.sqrt(((points[row] - centres[cell]) ** 2).sum(axis=1))
        else:
            distance = np.empty(0)
        ends = np.searchsorted(row, np.arange(len(points) + 1), side="left")
        items = pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(distance, pa.float64())], fields=list(CELL_TYPE.value_type)
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    return cells_of


def drawn_points(sample: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and vectors of a bounded sample ``(tid, cell_id, features)`` in an order drawn by ``seed``."""
    table = sample.select(unit_hash(seed, "tid").alias("drawn"), "tid", "cell_id", "features").toArrow()
    table = table.sort_by([("drawn", "ascending"), ("tid", "ascending")])
    return table["cell_id"].to_numpy(), block(table["features"])


def vector_rows(df: DataFrame, id_col: str, features_col: str, aux: tuple[str, ...], id_out: str) -> DataFrame:
    """``(id, features, aux...)`` of the rows that have a vector (PRJ6)."""
    return df.select(F.col(id_col).alias(id_out), as_doubles(df, features_col).alias("features"), *aux).where(
        "features is not null"
    )


def without_surplus_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Of equal vectors keep the ``copies`` lowest ids.

    No search for at most ``copies`` neighbours can return another one, because equal vectors tie in distance and the
    id decides. The limit applies before the shuffle, so a vector that fills a third of the table costs each task
    ``copies`` rows.
    """
    same = Window.partitionBy(F.xxhash64("features"), "features").orderBy("tid")
    return rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= copies).drop("_copy")


def sample_points(dimensions: int) -> int:
    """Vectors that the driver's sample may hold, from their width."""
    return max(2, SAMPLE_BYTES // (8 * max(1, dimensions)))


def cell_rows(dimensions: int) -> int:
    """Rows above which a cell is split again."""
    return max(1, CELL_BYTES // (8 * max(1, dimensions)))


def block_rows(dimensions: int) -> int:
    """Rows of one side that a search task holds."""
    return max(1, min(MOST_BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dimensions))))


def _grown_tree(rows: DataFrame, total: int, top_tree_size: int | None, leaf_size: int, seed: int, tau: float, balance: float,
                depth: float, dimensions: int):
    """The tree of a sample; a sample that the driver does not hold is split where it lies, with the same result."""
    tree = PivotTree()
    drawn = rows if top_tree_size is None else sample_rows(rows, "tid", top_tree_size, seed, total)
    if min(total, top_tree_size or total) > sample_points(dimensions):
        _grow_apart(tree, drawn.select(unit_hash(seed, "tid").alias("drawn"), "tid", "features"), leaf_size, tau, balance, depth, sample_points(dimensions))
        return tree
    _, points = drawn_points(drawn.withColumn("cell_id", F.lit(0)), seed)
    if not len(points):
        _, points = drawn_points(rows.limit(1).withColumn("cell_id", F.lit(0)), seed)
    tree.grow(points, leaf_size, tau, balance, depth)
    return tree


def _away_from(pivot: np.ndarray):
    """Arrow function: vector to its squared distance from ``pivot``."""

    @F.arrow_udf("double")
    def away(features: pa.Array) -> pa.Array:
        return pa.array(squared_to(block(features), pivot), pa.float64())

    return away


def _corners(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest values of all vectors; one row leaves a task."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in (block(b.column("features")) for b in batches) if len(x)]
        if held:
            found = [np.min([x.min(axis=0) for x in held], axis=0)], [np.max([x.max(axis=0) for x in held], axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())) for x in found], names=["low", "high"])

    rows = points.select("features").mapInArrow(ends, "low array<double>, high array<double>").collect()
    return np.min([r["low"] for r in rows], axis=0), np.max([r["high"] for r in rows], axis=0)


def _farthest(points: DataFrame, pivot: np.ndarray) -> tuple[float, np.ndarray]:
    """Squared distance and vector of the point farthest from ``pivot``, the first drawn of several."""
    away = points.select("features", _away_from(pivot)("features").alias("away"), "drawn", "tid")
    first = F.struct((-F.col("away")).alias("order"), "drawn", "tid")
    far = away.agg(F.min_by(F.struct("away", "features"), first).alias("far")).first()["far"]
    return far["away"], np.array(far["features"])


def _grow_apart(tree: PivotTree, points: DataFrame, leaf_size: int, tau: float, balance: float, depth: float, most: int) -> int:
    """``tree.grow`` for ``(drawn, tid, features)`` of any number: each node takes a few aggregations over its points.

    Nodes of up to ``most`` points are grown on the driver. Pivots, sides and order of nodes are the same either way.
    """
    count = points.count()
    if count <= most:
        table = points.toArrow().sort_by([("drawn", "ascending"), ("tid", "ascending")])
        return tree.grow(block(table["features"]), leaf_size, tau, balance, depth)
    if count <= leaf_size or depth < 1:
        return tree.new_cell(*_corners(points))
    first = np.array(points.agg(F.min_by("features", F.struct("drawn", "tid"))).first()[0])
    away, left = _farthest(points, first)
    if away == 0.0:
        return tree.new_cell(*_corners(points))
    _, right = _farthest(points, left)
    node = tree.new_node(left, right)
    sided = points.withColumn("to_left", _away_from(left)("features")).withColumn("to_right", _away_from(right)("features"))
    in_left, in_right = F.col("to_left") < F.col("to_right"), F.col("to_left") >= F.col("to_right")
    if balance > 0.0:
        gap = F.sqrt("to_left") - F.sqrt("to_right")
        wide = gap <= tau, -gap <= tau
        if max(sided.agg(*[F.count(F.when(side, 1)) for side in wide]).first()) <= balance * count:
            tree.overlapping[node] = True
            in_left, in_right = wide
    tree.children[node] = tuple(
        _grow_apart(tree, sided.where(side).select(*points.columns), leaf_size, tau, balance, depth - 1, most) for side in (in_left, in_right)
    )
    return node


def _assigned(rows: DataFrame, tree: PivotTree, tau: float, spill: str) -> DataFrame:
    side = "train" if spill == "train" else "nearest"
    placed = rows.withColumn("_cell", F.explode(router(tree, tau, side)("features")))
    return placed.select(*rows.columns, "_cell.cell_id", "_cell.centre_distance")


def _cell_stats(assigned: DataFrame) -> list:
    """One row per cell; there are no more cells than leaves of the driver's tree."""
    return assigned.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("size"), F.max("centre_distance").alias("radius")
    ).collect()


def _split_crowded(tree: PivotTree, assigned: DataFrame, stats: list, max_cell_rows: int, leaf_size: int,
                   seed: int, points_at_once: int, whole: set[int]) -> bool:
    """Split cells above ``max_cell_rows`` again, the largest first, each from a bounded sample of its own rows.

    Cells whose sample cannot be told apart are entered in ``whole`` and not tried again. False if none is left to try.
    """
    large = sorted(((r["size"], r["cell_id"]) for r in stats if r["size"] > max_cell_rows and r["cell_id"] not in whole), reverse=True)
    crowded = {c: n for n, c in large[: max(1, points_at_once // (4 * leaf_size))]}
    if not crowded:
        return False
    share = max(leaf_size + 1, points_at_once // len(crowded))
    wanted = {c: min(n, share, leaf_size * (2 + 2 * n // max_cell_rows)) for c, n in crowded.items()}
    fraction = F.create_map(*[F.lit(x) for c, n in crowded.items() for x in (c, wanted[c] / n)])
    drawn = assigned.where(F.col("cell_id").isin(list(crowded))).where(
        unit_hash(seed, F.lit("cell"), "tid") < fraction[F.col("cell_id")]
    )
    owner, points = drawn_points(drawn, seed)
    for c in sorted(crowded):
        own = points[owner == c]
        # a sample of less than two points is drawn anew in the next round
        if len(own) > 1 and not tree.split_cell(c, own, min(leaf_size, len(own) - 1)):
            whole.add(c)
    return True


def fit_cells(train: DataFrame, id_col: str = "tid", features_col: str = "features", aux: tuple[str, ...] = (), *,
              top_tree_size: int | None = 1000, top_tree_leaf_size: int = 10, top_tree_depth: float = math.inf, sub_tree_leaf_size: int = 30,
              buffer_size: float = -1.0, buffer_size_sample_sizes=SAMPLE_SIZES, balance_threshold: float = 0.7,
              spill: str = "query", seed: int = 0, copies: int | None = None, max_cell_rows: float | None = None,
              store: str | None = None) -> CellIndex:
    """Cut the training vectors into cells.

    A sample of ``top_tree_size`` points gives the tree, or every row if that is None, surplus copies included; it has at
    most ``top_tree_depth`` levels of nodes. Cells that turn out larger than ``max_cell_rows`` are split again from
    samples of their own, with ``sub_tree_leaf_size``. A cell is kept as blocks that fit one task,
    whatever its size. ``spill='train'`` stores points near an overlapping boundary on both sides; ``'query'`` sends
    queries to both sides instead. ``copies`` keeps only that many of equal vectors, exact for ``k <= copies``.
    ``store`` writes the cells to that path as a table; otherwise they are cached in memory and on disk.
    """
    if spill not in ("query", "train"):
        raise ValueError("spill is 'query' or 'train'")
    if min(1 if top_tree_size is None else top_tree_size, top_tree_leaf_size, top_tree_depth, sub_tree_leaf_size) < 1:
        raise ValueError("sizes of trees and leaves are at least 1")
    if buffer_size < 0 and buffer_size != -1:
        raise ValueError("buffer_size is -1 (estimated) or at least 0")
    if len(buffer_size_sample_sizes) < 2 or min(buffer_size_sample_sizes) < 1:
        raise ValueError("at least two positive sample sizes")
    if not 0 <= balance_threshold <= 1:
        raise ValueError("balance_threshold is from 0 to 1")
    spark = train.sparkSession
    every = vector_rows(train, id_col, features_col, aux, "tid")
    rows = every if copies is None else without_surplus_copies(every, copies)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    total, dimensions = rows.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    if not total:
        raise ValueError("no training vectors")
    if buffer_size >= 0:
        tau = buffer_size
    elif balance_threshold > 0:
        tau = estimate_tau(rows, "tid", "features", buffer_size_sample_sizes, seed, total)
    else:
        tau = 0.0
    balance = balance_threshold if spill == "train" else 0.0
    if top_tree_size is None and copies is not None:
        every = every.select("tid", "features").persist(StorageLevel.MEMORY_AND_DISK)
        tree = _grown_tree(every, every.count(), None, top_tree_leaf_size, seed, tau, balance, top_tree_depth, dimensions)
        every.unpersist()
    else:
        tree = _grown_tree(rows, total, top_tree_size, top_tree_leaf_size, seed, tau, balance, top_tree_depth, dimensions)
    max_cell_rows = max_cell_rows or cell_rows(dimensions)
    whole: set[int] = set()
    attempt = 0
    while True:
        assigned = _assigned(rows, tree, tau, spill)
        stats = _cell_stats(assigned)
        attempt += 1
        if not _split_crowded(tree, assigned, stats, max_cell_rows, sub_tree_leaf_size, seed + attempt, min(SPLIT_POINTS, sample_points(dimensions)), whole):
            break
    sizes = {r["cell_id"]: r["size"] for r in stats}
    share = max(BUNDLE_ROWS, -(-total // (BUNDLES_PER_CORE * spark.sparkContext.defaultParallelism)))
    index = CellIndex(
        tree, tau, spill, assigned, sizes, {r["cell_id"]: r["radius"] for r in stats},
        bundled(sizes, tree.cells, min(share, block_rows(dimensions))), {}, tuple(aux), dimensions, copies, buffer_size < 0,
    )
    index.blocks = {b: -(-n // block_rows(dimensions)) for b, n in index.bundle_rows().items()}
    index.rows = _stored(spark, index, store)
    rows.unpersist()
    return index


def single_cell(train: DataFrame, id_col: str = "tid", features_col: str = "features",
                aux: tuple[str, ...] = ()) -> CellIndex:
    """All training rows in one cell, for search without pruning (KNN2)."""
    rows = vector_rows(train, id_col, features_col, aux, "tid")
    measured = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    dimensions = measured["d"] or 1
    tree = PivotTree(centres=[np.zeros(dimensions)])
    assigned = rows.withColumn("cell_id", F.lit(0)).withColumn("bundle", F.lit(0))
    blocks = {0: max(1, -(-measured["n"] // block_rows(dimensions)))}
    placed = assigned.withColumn("block", F.pmod(F.xxhash64("tid"), F.lit(blocks[0])).cast("int"))
    return CellIndex(
        tree, 0.0, "query", placed, {0: measured["n"]}, {0: float("inf")}, np.zeros(1, int), blocks, tuple(aux), dimensions, None
    )


def numbers_by(df: DataFrame, key: str, values: dict[int, int], out: str, default: int) -> DataFrame:
    """Add a number known for each cell or bundle; only those with another number than ``default`` are spelled out."""
    special = {int(k): int(v) for k, v in values.items() if v != default}
    if not special:
        return df.withColumn(out, F.lit(default))
    table = df.sparkSession.createDataFrame(list(special.items()), f"{key} int, {out} int")
    # at most one row per leaf of the driver's tree
    return df.join(F.broadcast(table), key, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def _stored(spark, index: CellIndex, store: str | None) -> DataFrame:
    bundles = dict(enumerate(index.bundle_of))
    placed = numbers_by(index.rows.drop("centre_distance"), "cell_id", bundles, "bundle", 0)
    placed = numbers_by(placed, "bundle", index.blocks, "_blocks", 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("tid"), F.col("_blocks")).cast("int")).drop("_blocks")
    if store is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = placed.repartition(parts, "bundle", "block").persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
    else:
        placed.repartition("bundle", "block").sortWithinPartitions("bundle", "block").write.mode("overwrite").parquet(store)
        kept = spark.read.parquet(store)
    return kept


def cell_boxes(index_rows: DataFrame) -> DataFrame:
    """``cell_id, centre, radius`` of each cell's bounding box (AGG15).

    Minimum and maximum are combined in each task, so one row per cell and dimension is shuffled.
    """
    values = index_rows.select("cell_id", F.posexplode("features").alias("dim", "value"))
    sides = values.groupBy("cell_id", "dim").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = F.array_sort(F.collect_list(F.struct("dim", ((F.col("low") + F.col("high")) / 2).alias("mid"))))
    return sides.groupBy("cell_id").agg(
        F.transform(placed, lambda s: s["mid"]).alias("centre"),
        (F.sqrt(F.sum((F.col("high") - F.col("low")) ** 2)) / 2).alias("radius"),
    )


def farthest_point(points: DataFrame, pivot_id, id_col: str = "tid") -> DataFrame:
    """``tid, distance`` of the point farthest from the point ``pivot_id``; the lower id wins a tie (AGG16)."""
    pivot = block(points.where(F.col(id_col) == pivot_id).select("features").toArrow()["features"])[0]

    @F.arrow_udf("double")
    def away(features: pa.Array) -> pa.Array:
        return pa.array(np.sqrt(squared_to(block(features), pivot)), pa.float64())

    measured = points.select(F.col(id_col).alias("tid"), away("features").alias("distance"))
    first = F.struct((-F.col("distance")).alias("order"), "tid")
    far = measured.agg(F.min_by(F.struct("tid", "distance"), first).alias("far"))
    return far.select("far.tid", "far.distance")

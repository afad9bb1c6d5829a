"""An index kept as tables, opened again in any session (KNN3, KNN4, PRT1, CCH1, JOIN5).

The tree is a table of subtrees. Each round splits every cell that is still too large: a bounded sample of the cell's own
rows gives a subtree of at most ``SUBTREE_POINTS`` points, grown where the sample lies, and the rows of split cells alone
move on to its leaves. A row or query goes down one table level at a time: a level whose subtrees are measured to fit
``ROUTER_BYTES`` is sent to the tasks, a larger one meets the vectors by a shuffle on the cell, so neither the driver nor a
closure holds the tree.

Training rows are a Parquet table bucketed by (bundle, block): a bundle is a run of sibling cells that one task searches, cut
into blocks where it is too large for a task. A search shuffles the queries to the buckets and reads the rows where they lie.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlekit.knn.cells import BUNDLE_ROWS, BUNDLES_PER_CORE, block_rows, cell_rows, vector_rows
from titlekit.knn.probing import DEFAULT_RECALL, SAMPLE_QUERIES, exact_of_sample, probes_for, sampled_queries
from titlekit.knn.search import DEFAULT_K, TASK_FOUND, TASK_PAIRS, _arrow_schema, _ranked, _searcher, knn_exact
from titlekit.knn.tree import PivotTree
from titlekit.knn.vectors import block
from titlekit.operators.lookup import lookup_join
from titlekit.operators.ranking import top_k
from titlekit.operators.sampling import unit_hash
from titlekit.session import materialise

ROOT = 1
LEAF_BITS = 12
SUBTREE_POINTS = 4096
LEAF_POINTS = 30
ROUTER_BYTES = 64 * 1024 * 1024
MOST_LEVELS = 5

TREE = "cell bigint, level int, lefts array<array<double>>, rights array<array<double>>, children array<array<int>>, leaves int"
BEAM = "array<struct<cell:bigint,margin:double>>"


@dataclass
class StoredIndex:
    """The tables of an index, and the few numbers that its searches need."""

    folder: str
    rows: DataFrame  # tid, features, aux..., cell_id, bundle, block; bucketed by bundle and block
    tree: DataFrame  # one subtree a row
    cells: DataFrame  # cell, bundle, blocks, n
    total: int
    dimensions: int
    levels: int
    aux: tuple[str, ...]


def _subtree_row(tree: PivotTree, cell: int, level: int) -> pa.RecordBatch:
    values = [[cell], [level], [[p.tolist() for p in tree.left_pivot]], [[p.tolist() for p in tree.right_pivot]], [[list(c) for c in tree.children]], [tree.cells]]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.int32())), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["cell", "level", "lefts", "rights", "children", "leaves"])


def _subtree(lefts: list, rights: list, children: list, leaves: int) -> PivotTree:
    left, right = [np.array(p) for p in lefts], [np.array(p) for p in rights]
    return PivotTree(left, right, [tuple(c) for c in children], [False] * len(children), [np.zeros(len(left[0]))] * leaves)


def _child(cell, leaf):
    return (cell << LEAF_BITS) | leaf


def grown(crowded: DataFrame, rows: DataFrame, level: int, max_cell_rows: int, seed: int) -> DataFrame:
    """Subtrees (``TREE``) of the cells ``(cell, n)``, each from a sample of its ``rows (cell, tid, features)``.

    The expected size of a sample follows from the cell's rows and is at most ``SUBTREE_POINTS``. A cell whose sample
    cannot be told apart has no subtree.
    """
    wanted = F.least(F.lit(SUBTREE_POINTS), LEAF_POINTS * (2 + 2 * F.ceil(F.col("n") / max_cell_rows)))
    shares = crowded.select("cell", (wanted / F.col("n")).alias("share"))
    place = unit_hash(seed + level, F.lit("subtree"), "tid")
    drawn = lookup_join(rows.select("cell", "tid", "features"), shares, ["cell"]).withColumn("place", place).where("place < share")

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("tid", "ascending")])
        tree = PivotTree()
        tree.grow(block(table["features"]), LEAF_POINTS)
        made = pa.Table.from_batches([_subtree_row(tree, table["cell"][0].as_py(), level)])
        return made if tree.children else made.slice(0, 0)

    return drawn.select("cell", "tid", "place", "features").groupBy("cell").applyInArrow(grow, TREE)


def router_bytes(subtrees: DataFrame) -> int:
    """What the pivots of these subtrees take."""
    width = F.aggregate("lefts", F.lit(0), lambda a, p: a + F.size(p))
    return subtrees.agg(F.coalesce(F.sum(16 * width + 64 * F.size("children")), F.lit(0))).first()[0]


class _Sent:
    """Subtrees by cell, as tasks hold them."""

    def __init__(self, rows: list):
        self.trees = {r["cell"]: (r["lefts"], r["rights"], r["children"], r["leaves"]) for r in rows}
        self.built: dict[int, PivotTree] = {}

    def get(self, cell: int) -> PivotTree | None:
        if cell not in self.built and cell in self.trees:
            self.built[cell] = _subtree(*self.trees[cell])
        return self.built.get(cell)


def _sent(subtrees: DataFrame):
    return subtrees.sparkSession.sparkContext.broadcast(_Sent(subtrees.collect()))


def routed_rows(rows: DataFrame, subtrees: DataFrame, limit: int = ROUTER_BYTES) -> DataFrame:
    """``rows`` with ``cell`` moved on to the leaf of the cell's subtree, where it has one."""
    if router_bytes(subtrees) <= limit:
        sent = _sent(subtrees)

        @F.arrow_udf("bigint")
        def leaf(cell: pa.Array, features: pa.Array) -> pa.Array:
            at, points = cell.to_numpy().copy(), block(features)
            before = at.copy()
            for c in np.unique(before):
                tree = sent.value.get(int(c))
                if tree is not None:
                    own = np.flatnonzero(before == c)
                    row, leaves = tree.route(points[own])
                    at[own[row]] = _child(c, leaves)
            return pa.array(at)

        return rows.withColumn("cell", leaf("cell", "features"))
    return _by_cell(rows, subtrees, _moved)


def _moved(tree: PivotTree, table: pa.Table) -> pa.Table:
    row, leaves = tree.route(block(table["features"]))
    cell = table["cell"].to_numpy().copy()
    cell[row] = _child(cell[row], leaves)
    return table.set_column(table.schema.get_field_index("cell"), "cell", pa.array(cell))


def _by_cell(rows: DataFrame, subtrees: DataFrame, move, schema: T.StructType | None = None) -> DataFrame:
    """``move(tree, rows of a cell)`` by a shuffle on the cell; a cell of many rows is met in parts, each with the subtree.

    Rows of cells without a subtree are passed on as they are.
    """
    counts = materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(subtrees.select("cell"), "cell"))
    limit = block_rows(max(1, (rows.select(F.size("features")).first() or [1])[0] or 1))
    parts = counts.select("cell", F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
    ours = lookup_join(rows, parts, ["cell"]).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_parts")
    copies = subtrees.join(parts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_parts")
    schema = schema or rows.schema
    names = schema.names

    def meet(held: pa.Table, trees: pa.Table) -> pa.Table:
        own = trees.select(["lefts", "rights", "children", "leaves"]).to_pylist()[0]
        return move(_subtree(**own), held).select(names).cast(_arrow_schema(schema))

    met = ours.groupBy("cell", "_part").cogroup(copies.groupBy("cell", "_part")).applyInArrow(meet, schema)
    return met.unionByName(lookup_join(rows, parts.select("cell"), ["cell"], "left_anti").select(*names))


def store_index(train: DataFrame, folder: str, id_col: str = "tid", features_col: str = "features", aux: tuple[str, ...] = (), *,
                max_cell_rows: int | None = None, buckets: int | None = None, seed: int = 0, limit: int = ROUTER_BYTES) -> StoredIndex:
    """Fit an index and write its tables under ``folder``: ``tree``, ``cells``, ``rows`` and ``facts``.

    ``limit`` bounds what routing sends to the tasks; see ``routed_rows``.
    """
    spark = train.sparkSession
    rows = vector_rows(train, id_col, features_col, aux, "tid").withColumn("cell", F.lit(ROOT).cast("bigint"))
    rows = materialise(rows)
    total, dimensions, least = rows.agg(F.count(F.lit(1)), F.max(F.size("features")), F.min(F.size("features"))).first()
    if not total:
        raise ValueError("no training vectors")
    if dimensions != least:
        raise ValueError("vectors differ in length")
    max_cell_rows = max_cell_rows or cell_rows(dimensions)
    settled, moving, levels = [], rows, []
    for level in range(MOST_LEVELS):
        counts = moving.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_cell_rows)
        subtrees = materialise(grown(materialise(counts), moving, level, max_cell_rows, seed))
        if subtrees.isEmpty():
            break
        levels.append(subtrees)
        split = subtrees.select("cell")
        settled.append(lookup_join(moving, split, ["cell"], "left_anti"))
        moving = materialise(routed_rows(lookup_join(moving, split, ["cell"], "left_semi"), subtrees, limit))
    placed = moving
    for rest in settled:
        placed = placed.unionByName(rest)
    tree = spark.createDataFrame([], TREE)
    for subtrees in levels:
        tree = tree.unionByName(subtrees)
    tree.write.mode("overwrite").parquet(f"{folder}/tree")

    # sibling cells are put together up to a task's share; a subtree has fewer than 2 ** LEAF_BITS leaves
    share = min(max(BUNDLE_ROWS, -(-total // (BUNDLES_PER_CORE * spark.sparkContext.defaultParallelism))), block_rows(dimensions))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    siblings = Window.partitionBy("parent").orderBy("cell")
    runs = sizes.withColumn("parent", F.shiftright("cell", LEAF_BITS))
    runs = runs.withColumn("filled", F.floor((F.sum("n").over(siblings) - 1) / share))
    runs = runs.withColumn("run", F.dense_rank().over(Window.partitionBy("parent").orderBy("filled")) - 1)
    runs = runs.withColumn("bundle", F.shiftleft("parent", LEAF_BITS).bitwiseOR(F.col("run").cast("bigint")))
    held = runs.groupBy("bundle").agg(F.ceil(F.sum("n") / block_rows(dimensions)).cast("int").alias("blocks"))
    runs.join(held, "bundle").select("cell", "bundle", "blocks", "n").write.mode("overwrite").parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")

    out = lookup_join(placed, cells.select("cell", "bundle", "blocks"), ["cell"])
    out = out.withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")).withColumnRenamed("cell", "cell_id").drop("blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(parts, -(-total * dimensions * 8 // (128 << 20)))
    name = _table_name()
    spread = out.repartition(buckets, "bundle", "block")
    spread.write.bucketBy(buckets, "bundle", "block").sortBy("bundle", "block").option("path", f"{folder}/rows").mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    facts = [(total, dimensions, len(levels), buckets, list(aux), out.schema.json())]
    spark.createDataFrame(facts, "total bigint, dimensions int, levels int, buckets int, aux array<string>, schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/facts")
    return open_index(spark, folder)


def _table_name() -> str:
    return f"titlekit_cells_{uuid.uuid4().hex}"


def open_index(spark: SparkSession, folder: str) -> StoredIndex:
    """The index that ``store_index`` wrote, in this session; its bucketing is entered in the session's catalog."""
    facts = spark.read.parquet(f"{folder}/facts").first()
    schema = T.StructType.fromJson(json.loads(facts["schema"]))
    name = _table_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (bundle, block) SORTED BY (bundle, block) INTO {facts['buckets']} BUCKETS LOCATION '{folder}/rows'")
    return StoredIndex(folder, spark.table(name), spark.read.parquet(f"{folder}/tree"), spark.read.parquet(f"{folder}/cells"), facts["total"], facts["dimensions"], facts["levels"], tuple(facts["aux"]))


def beams(index: StoredIndex, asked: DataFrame, probes: int, limit: int = ROUTER_BYTES) -> DataFrame:
    """``asked (qid, features)`` with ``beam``: the ``probes`` cells of least margin, level by level.

    No cell has a smaller margin than one above it, and below every cell there is one of the same margin; so the best
    cells of a level are below the best of the level before, and keeping ``probes`` of them loses none.
    """
    out = asked.withColumn("beam", F.array(F.struct(F.lit(ROOT).cast("bigint").alias("cell"), F.lit(0.0).alias("margin"))).cast(BEAM))
    for level in range(index.levels):
        subtrees = index.tree.where(F.col("level") == level)
        out = _sent_beam(out, subtrees, probes) if router_bytes(subtrees) <= limit else _met_beam(out, subtrees, probes)
    return out


def _spread_beam(trees, points: np.ndarray, row: np.ndarray, cell: np.ndarray, margin: np.ndarray, probes: int):
    """(row, cell, margin) after one more level; ``trees`` gives the subtree of a cell or None."""
    found = []
    for c in np.unique(cell):
        own, tree = np.flatnonzero(cell == c), trees(int(c))
        if tree is None:
            found.append((row[own], cell[own], margin[own]))
            continue
        at, leaf, beyond = tree.nearest_cells(points[row[own]], probes, margin[own])
        found.append((row[own][at], _child(c, leaf), beyond))
    row, cell, margin = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((cell, margin, row))
    row, cell, margin = row[order], cell[order], margin[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < probes
    return row[kept], cell[kept], margin[kept]


def _sent_beam(asked: DataFrame, subtrees: DataFrame, probes: int) -> DataFrame:
    sent = _sent(subtrees)

    @F.arrow_udf(BEAM)
    def further(features: pa.Array, beam: pa.Array) -> pa.Array:
        points, items = block(features), beam.flatten()
        if not len(points):
            return beam
        row = np.repeat(np.arange(len(points)), np.diff(beam.offsets.to_numpy()))
        row, cell, margin = _spread_beam(sent.value.get, points, row, items.field("cell").to_numpy(), items.field("margin").to_numpy(), probes)
        made = pa.StructArray.from_arrays([pa.array(cell, pa.int64()), pa.array(margin, pa.float64())], names=["cell", "margin"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(points) + 1)), pa.int32()), made)

    return asked.withColumn("beam", further("features", "beam"))


def _met_beam(asked: DataFrame, subtrees: DataFrame, probes: int) -> DataFrame:
    """The same by a shuffle of (query, cell) to the subtrees, and one of the results back to the query."""
    asked = materialise(asked)
    open_ones = asked.select("qid", "features", F.inline("beam"))

    def move(tree: PivotTree, held: pa.Table) -> pa.Table:
        cell, margin = held["cell"].to_numpy(), held["margin"].to_numpy()
        row, cell, margin = _spread_beam(lambda c: tree, block(held["features"]), np.arange(len(cell)), cell, margin, probes)
        return pa.table({"qid": held["qid"].take(pa.array(row)), "cell": pa.array(cell), "margin": pa.array(margin)})

    fields = [asked.schema["qid"], T.StructField("cell", T.LongType()), T.StructField("margin", T.DoubleType())]
    moved = _by_cell(open_ones, subtrees, move, T.StructType(fields))
    best = top_k(moved, ["qid"], [F.col("margin").asc(), F.col("cell").asc()], probes)
    gathered = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("margin", "cell"))), lambda x: F.struct(x["cell"].alias("cell"), x["margin"].alias("margin"))).alias("beam"))
    return asked.drop("beam").join(gathered, "qid")


def needed_probes(index: StoredIndex, asked: DataFrame, k: int, recall: float = DEFAULT_RECALL, max_distance: float = math.inf,
                  sample: int = SAMPLE_QUERIES, limit: int = ROUTER_BYTES) -> int:
    """Visits for the wanted recall, from a sample of the queries and one pass over the rows (see ``probing``).

    Beams of twice the width are tried until they hold enough of the sample's neighbours.
    """
    if not 0 < recall <= 1:
        raise ValueError("recall is above 0 and at most 1")
    drawn = sampled_queries(asked, sample)
    if not drawn.num_rows:
        return 1
    rows = index.rows.select("tid", "features", F.array("cell_id").alias("cells"))
    wanted: dict[int, list[int]] = {}
    for r in exact_of_sample(rows, block(drawn["features"]), k, max_distance).collect():
        wanted.setdefault(r["q"], []).append(r["cells"][0])
    few = asked.sparkSession.createDataFrame(drawn.select(["features"]).append_column("qid", pa.array(range(drawn.num_rows), pa.int64())))
    count, most = 8, index.cells.count()
    while True:
        count = min(count, most)
        beam = {r["qid"]: [b["cell"] for b in r["beam"]] for r in beams(index, few, count, limit).select("qid", "beam").collect()}
        beyond = most + 1
        places = []
        for q, cells in wanted.items():
            place = {c: i + 1 for i, c in enumerate(beam[q])}
            places.append([place.get(c, beyond) for c in cells])
        found = probes_for(places, recall, most)
        if found <= count or count >= most:
            return min(found, most)
        count *= 2


def search_stored(index: StoredIndex, queries: DataFrame, id_col: str = "qid", features_col: str = "features", k: int = DEFAULT_K,
                  max_distance: float = math.inf, recall: float | None = None, probes: int | None = None, limit: int = ROUTER_BYTES) -> DataFrame:
    """Neighbours ``qid, tid, distance, rank, aux...`` among the visited cells of a stored index.

    ``probes`` cells are visited by each query, or as many as ``recall`` needs (``DEFAULT_RECALL`` if neither is given); with
    at least as many probes as the index has cells the result is exact. No beam of all cells is then formed, which would
    grow with the queries times the cells: blocks of the stored rows meet parts of the queries.
    """
    if k < 1 or not max_distance > 0:
        raise ValueError("k is at least 1 and the greatest distance above 0")
    asked = vector_rows(queries, id_col, features_col, (), "qid")
    if probes is None:
        probes = needed_probes(index, asked, k, recall or DEFAULT_RECALL, max_distance, limit=limit)
    if probes >= index.cells.count():
        # a row that is there twice counts once among the nearest, as in a search by cells
        return knn_exact(index.rows.dropDuplicates(["tid", "features"]), asked, k, max_distance, index.aux)
    beam = materialise(beams(index, asked, probes, limit))
    visits = beam.select("qid", F.explode("beam.cell").alias("cell"))
    placed = lookup_join(visits, index.cells.select("cell", "bundle", "blocks"), ["cell"])
    by_bundle = placed.groupBy("qid", "bundle").agg(F.first("blocks").alias("blocks"), F.collect_list("cell").alias("cells"))
    routed = materialise(by_bundle.join(beam.select("qid", "features"), "qid"))

    rows_of = index.cells.groupBy("bundle").agg(F.sum("n").alias("n"))
    rows_at_once = block_rows(index.dimensions)
    held = F.least("n", F.lit(rows_at_once))
    counts = routed.groupBy("bundle").agg(F.count(F.lit(1)).alias("asked")).join(rows_of, "bundle")
    most = [F.col("asked") / rows_at_once, F.col("asked") * held / TASK_PAIRS, F.col("asked") * F.least(held, F.lit(k)) / TASK_FOUND]
    parts = F.greatest(*[F.ceil(x) for x in most]).cast("int")
    hot = materialise(counts.select("bundle", parts.alias("parts")).where("parts > 1"))

    schema = T.StructType([routed.schema["qid"], index.rows.schema["tid"], T.StructField("distance", T.DoubleType()), *[index.rows.schema[c] for c in index.aux]])
    function = _searcher(k, max_distance, index.aux, _arrow_schema(schema))
    to_blocks = routed.select("qid", "features", "bundle", "cells", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    if hot.isEmpty():
        keys = ["bundle", "block"]
        return _ranked(index.rows.groupBy(*keys).cogroup(to_blocks.groupBy(*keys)).applyInArrow(function, schema), k)
    # bundles with very many queries are a grid of blocks times query parts; only their rows are shuffled
    keys = ["bundle", "block"]
    quiet = lookup_join(index.rows, hot.select("bundle"), ["bundle"], "left_anti").groupBy(*keys).cogroup(
        lookup_join(to_blocks, hot.select("bundle"), ["bundle"], "left_anti").groupBy(*keys)).applyInArrow(function, schema)
    keys = ["bundle", "block", "part"]
    copies = lookup_join(index.rows, hot, ["bundle"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    dealt = lookup_join(to_blocks, hot, ["bundle"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
    grid = copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(function, schema)
    return _ranked(quiet.unionByName(grid), k)

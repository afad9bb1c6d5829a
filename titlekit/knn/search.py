"""Nearest-neighbour joins (KNN2, KNN4, KNN7, KNN9, JOIN4-JOIN6, FLT3)."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlekit.knn.cells import CellIndex, block_rows, numbers_by, single_cell, vector_rows
from titlekit.knn.probing import DEFAULT_RECALL, calibrated_probes
from titlekit.knn.vectors import CHUNK_CELLS, block, nearest_in_block
from titlekit.operators.ranking import top_k
from titlekit.session import materialise

DEFAULT_K = 5
# Vector pairs that one task compares.
TASK_PAIRS = 1 << 28
# Neighbours that one task returns, and that it gathers before it keeps the best of them.
TASK_FOUND = 1 << 19
# The same in a search that reads one block after the other: neighbours that a task holds, visits of its queries, rows it returns at a time.
STREAM_FOUND = 1 << 21
STREAM_VISITS = 1 << 21
RETURNED_ROWS = 1 << 16
# Visits of queries to cells that are put in order at a time.
VISITS_AT_ONCE = 1 << 18
# Rows per wanted neighbour that the first step of the exact search looks at, where its cells are smaller.
FIRST_ROWS = 8
# Added to a bound so that rounding never rules out a cell; it only costs a visit.
SLACK = 1e-6


def _best(q: np.ndarray, p: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest of each query by (distance, id), each point once."""
    order = np.lexsort((ids[p], distance, q))
    q, p, distance = q[order], p[order], distance[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (ids[p[1:]] != ids[p[:-1]])
    q, p, distance = q[fresh], p[fresh], distance[fresh]
    kept = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[kept], p[kept], distance[kept]


def _in_cells(cell: np.ndarray, points: np.ndarray, ids: np.ndarray, asked: np.ndarray, visitor: np.ndarray, visited: np.ndarray,
              k: int, max_distance: float, bound: np.ndarray | None = None):
    """(query, point, distance) arrays of each cell of some training rows; query ``visitor[i]`` visits cell ``visited[i]``, in order of the cells."""
    by_cell = np.argsort(cell, kind="stable")
    for c in np.unique(cell):
        members = by_cell[slice(*np.searchsorted(cell, [c, c + 1], sorter=by_cell))]
        callers = visitor[slice(*np.searchsorted(visited, [c, c + 1]))]
        if len(callers):
            limits = None if bound is None else bound[callers]
            q, p, distance = nearest_in_block(asked[callers], points[members], ids[members], k, max_distance, limits)
            yield callers[q], members[p], distance


def _in_order(visitor: np.ndarray, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(visited, kind="stable")
    return visitor[order], visited[order]


def _searcher(k: int, max_distance: float, aux: tuple[str, ...], schema: pa.Schema):
    def search(train: pa.Table, queries: pa.Table) -> pa.Table:
        if train.num_rows == 0 or queries.num_rows == 0:
            return schema.empty_table()
        ids = train["tid"].combine_chunks().to_numpy(zero_copy_only=False)
        points, asked = block(train["features"]), block(queries["features"])
        visits = queries["cells"].combine_chunks()
        visitor = np.repeat(np.arange(len(asked)), np.diff(visits.offsets.to_numpy()))
        visitor, visited = _in_order(visitor, visits.flatten().to_numpy())
        found, gathered = [], 0
        for met in _in_cells(train["cell_id"].to_numpy(), points, ids, asked, visitor, visited, k, max_distance):
            found.append(met)
            gathered += len(met[0])
            if len(found) > 1 and gathered > TASK_FOUND:
                found = [_best(*[np.concatenate(part) for part in zip(*found)], ids, k)]
                gathered = 0
        if not found:
            return schema.empty_table()
        q, p, distance = _best(*[np.concatenate(part) for part in zip(*found)], ids, k)
        near = train.take(pa.array(p))
        columns = [queries["qid"].take(pa.array(q)), near["tid"], pa.array(distance, pa.float64())]
        return pa.table([*columns, *[near[c] for c in aux]], schema=schema)

    return search


def task_parts(asked: int, rows: int, k: int, dimensions: int) -> int:
    """Parts of ``asked`` queries that meet ``rows`` training rows, so that a task's queries, pairs and results are bounded."""
    held = min(rows, block_rows(dimensions))
    return max(-(-asked // block_rows(dimensions)), -(-asked * held // TASK_PAIRS), -(-asked * min(k, held) // TASK_FOUND))


def visits_in_steps(points: np.ndarray, cells: int, bundle_of: np.ndarray, visited) -> pa.Array:
    """``bundle_visits`` of all points, a few at a time; ``visited(lo, hi)`` gives the (row, cell) pairs of some, rows from 0."""
    step = max(1, VISITS_AT_ONCE // max(1, cells))
    made = [bundle_visits(*visited(lo, lo + step), min(step, len(points) - lo), bundle_of) for lo in range(0, max(1, len(points)), step)]
    return pa.concat_arrays(made)


def bundle_visits(rows: np.ndarray, cells: np.ndarray, count: int, bundle_of: np.ndarray) -> pa.Array:
    """(row, cell) pairs as one list per row of the bundles it visits, with its cells in each."""
    order = np.lexsort((cells, bundle_of[cells], rows))
    rows, cells = rows[order], cells[order]
    bundles = bundle_of[cells]
    starts = np.ones(len(rows), bool)
    starts[1:] = (rows[1:] != rows[:-1]) | (bundles[1:] != bundles[:-1])
    first = np.flatnonzero(starts)
    inner = pa.ListArray.from_arrays(pa.array([*first, len(rows)], pa.int32()), pa.array(cells, pa.int32()))
    items = pa.StructArray.from_arrays([pa.array(bundles[first], pa.int32()), inner], names=["bundle", "cells"])
    ends = np.searchsorted(rows[first], np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


VISITS = "array<struct<bundle:int,cells:array<int>>>"


def _routed(queries: DataFrame, visits: Column) -> DataFrame:
    """``qid, features, bundle, cells`` from a column of visits."""
    return queries.select("qid", "features", F.inline(visits))


def search_cells(index: CellIndex, queries: DataFrame, visits: Column, k: int, max_distance: float = math.inf) -> DataFrame:
    """``qid, tid, distance, aux...``: the best ``k`` of each block that a query visits, or of all of them.

    ``visits`` gives the visits of ``queries`` ``(qid, features)``; both are evaluated twice, because visits to many
    cells take far more room than the vectors. Queries are shuffled to the bundles they visit (``_by_bundle``) unless
    that moves more bytes than to read all training rows once for each part of the queries (``streamed``). Either way
    gives the same neighbours.
    """
    routed = queries.select("qid", "features", F.inline(visits))
    counts = routed.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("cells")).collect()
    made, cells, asked = {r["bundle"]: r["n"] for r in counts}, sum(r["cells"] for r in counts), queries.count()
    held = index.bundle_rows()
    total, width = sum(held.values()), 8 * index.dimensions + 24
    grid = {b: task_parts(n, held.get(b, 0), k, index.dimensions) for b, n in made.items()}
    moved = sum(width * (n * index.blocks.get(b, 1) + held.get(b, 0) * (grid[b] if grid[b] > 1 else 0))
                + 24 * n * min(k * index.blocks.get(b, 1), held.get(b, 0)) for b, n in made.items())
    parts = stream_parts(index, asked, total, k, cells)
    if min(k, total) <= STREAM_FOUND and moved > width * (asked + total * parts) + 24 * asked * min(k, total):
        return streamed(index, queries, visits, k, max_distance, parts)
    return _by_bundle(index, routed, k, max_distance, made, {b: n for b, n in grid.items() if n > 1})


def _found_schema(index: CellIndex, qid: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid),
        T.StructField("tid", index.rows.schema["tid"].dataType),
        T.StructField("distance", T.DoubleType()),
        *[index.rows.schema[c] for c in index.aux],
    ])


def _by_bundle(index: CellIndex, routed: DataFrame, k: int, max_distance: float, visits: dict[int, int], grid: dict[int, int]) -> DataFrame:
    """The best ``k`` of each block, for ``routed`` ``(qid, features, bundle, cells)``: a query is sent once to each bundle, with the cells it visits there.

    A task gets one block of training rows and the queries of its bundle. Bundles with more queries than suit one task
    are searched as a ``grid`` of training blocks times query parts, so a cell that draws a third of all queries is spread
    evenly; a task holds bounded data and compares a bounded number of pairs, and only the best ``k`` per query leave it.
    """
    held = index.bundle_rows()
    schema = _found_schema(index, routed.schema["qid"].dataType)
    function = _searcher(k, max_distance, index.aux, _arrow_schema(schema))
    to_blocks = numbers_by(routed, "bundle", index.blocks, "_blocks", 1).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).drop("_blocks")
    quiet = [b for b in visits if b not in grid]
    found = None
    if quiet or not grid:
        rows = index.rows if len(quiet) == len(held) else index.rows.where(F.col("bundle").isin(quiet))
        asked = to_blocks if not grid else to_blocks.where(F.col("bundle").isin(quiet))
        keys = ["bundle", "block"]
        found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(function, schema)
    if grid:
        keys = ["bundle", "block", "part"]
        hot = F.col("bundle").isin(list(grid))
        rows = numbers_by(index.rows.where(hot), "bundle", grid, "_parts", 1).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        ).drop("_parts")
        asked = numbers_by(to_blocks.where(hot), "bundle", grid, "_parts", 1).withColumn(
            "part", F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int")
        ).drop("_parts")
        spread = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(function, schema)
        found = spread if found is None else found.unionByName(spread)
    return found


def stream_parts(index: CellIndex, asked: int, total: int, k: int, cells: int) -> int:
    """Parts of the queries of a streamed search: queries, visits and results of each are bounded, and all cores have some."""
    most = max(-(-asked // block_rows(index.dimensions)), -(-asked * min(k, total) // STREAM_FOUND), -(-cells // STREAM_VISITS))
    return max(1, most, min(asked, 2 * index.rows.sparkSession.sparkContext.defaultParallelism))


def streamed(index: CellIndex, queries: DataFrame, visits: Column, k: int, max_distance: float, parts: int, ranked: bool = False) -> DataFrame:
    """``qid, tid, distance, aux...``: the best ``k`` of all the cells that a query visits, and with ``ranked`` their rank.

    The training rows are written down once, as blocks. A task holds one part of the queries and the best of what it has
    met, and reads one block after the other, so neither rows nor queries nor neighbours are shuffled; a query's k-th
    distance so far rules out most of the later pairs. With fewer parts than cores the blocks are dealt to several tasks,
    whose best ``k`` are all returned. Ranks are of one task, so they are only asked for where there are as many parts.
    """
    spark = queries.sparkSession
    schema = _found_schema(index, queries.schema["qid"].dataType)
    if ranked:
        schema.add("rank", T.IntegerType())
    blocks = materialise(index.rows.select("tid", "features", "cell_id", *index.aux).mapInArrow(_packed(block_rows(index.dimensions)), "data binary"))
    asked = queries.repartition(parts).select("qid", "features", visits.alias("visits")).mapInArrow(_packed(None), "data binary")
    strips = 1 if ranked else max(1, 2 * spark.sparkContext.defaultParallelism // parts)
    search = _streamer(k, max_distance, index.aux, _arrow_schema(schema), ranked)
    met = asked.rdd.cartesian(blocks.coalesce(strips).rdd).mapPartitions(search)
    return spark.createDataFrame(met, "data binary").mapInArrow(_unpacked, schema)


def _written(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])


def _packed(rows: int | None):
    """mapInArrow function: each ``rows`` rows, or a whole partition, as one value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if rows is None:
                held.append(batch)
                continue
            for lo in range(0, batch.num_rows, rows):
                yield _written([batch.slice(lo, rows)])
        if held:
            yield _written(held)

    return pack


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("data"):
            yield from pa.ipc.open_stream(value.as_buffer())


def _streamer(k: int, max_distance: float, aux: tuple[str, ...], schema: pa.Schema, ranked: bool):
    def part_of(queries: pa.Table, blocks: Iterator[bytes]) -> pa.Table | None:
        asked = block(queries["features"])
        visits = queries["visits"].combine_chunks()
        cells = visits.flatten().field("cells")
        visitor = np.repeat(np.repeat(np.arange(len(asked)), np.diff(visits.offsets.to_numpy())), np.diff(cells.offsets.to_numpy()))
        visitor, visited = _in_order(visitor, cells.flatten().to_numpy())
        bound = np.full(len(asked), max_distance)
        near, q, distance = None, np.empty(0, int), np.empty(0)
        for data in blocks:
            train = _read(data)
            rows, found, gathered = train.select(["tid", *aux]), [], 0
            cells = train["cell_id"].to_numpy()
            for met in _in_cells(cells, block(train["features"]), train["tid"].to_numpy(), asked, visitor, visited, k, max_distance, bound):
                found.append(met)
                gathered += len(met[0])
                if gathered > TASK_FOUND:
                    q, near, distance = joined(q, near, distance, rows, found, bound)
                    found, gathered = [], 0
            if gathered:
                q, near, distance = joined(q, near, distance, rows, found, bound)
        if near is None:
            return None
        q, near, distance = kept_best(q, near, distance)
        columns = [queries["qid"].take(pa.array(q)), near["tid"], pa.array(distance, pa.float64()), *[near[c] for c in aux]]
        if ranked:
            columns.append(pa.array(np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1, pa.int32()))
        return pa.table(columns, schema=schema)

    def joined(q: np.ndarray, near: pa.Table | None, distance: np.ndarray, rows: pa.Table, found: list, bound: np.ndarray):
        """What is held and what was found among ``rows``; no more than the best where some queries have more than they want."""
        at, p, away = [np.concatenate(x) for x in zip(*found)]
        new = rows.take(pa.array(p))
        near = new if near is None else pa.concat_tables([near, new])
        q, distance = np.concatenate([q, at]), np.concatenate([distance, away])
        if len(q) > k * len(bound):
            q, near, distance = kept_best(q, near, distance)
            full = np.flatnonzero(np.bincount(q, minlength=len(bound)) == k)
            bound[full] = distance[np.searchsorted(q, full, side="right") - 1]
        return q, near, distance

    def kept_best(q: np.ndarray, near: pa.Table, distance: np.ndarray):
        q, p, distance = _best(q, np.arange(len(q)), distance, near["tid"].to_numpy(), k)
        return q, near.take(pa.array(p)), distance

    def search(pairs: Iterator) -> Iterator[tuple[bytes]]:
        # the queries stay the same while one block follows the other
        for data, group in itertools.groupby(pairs, key=lambda pair: bytes(pair[0]["data"])):
            found = part_of(_read(data), (bytes(pair[1]["data"]) for pair in group))
            if found is not None:
                for batch in found.combine_chunks().to_batches(max_chunksize=RETURNED_ROWS):
                    yield (_written([batch]).column("data")[0].as_py(),)

    return search


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["qid"], [F.col("distance").asc(), F.col("tid").asc()], k)


def _check_search(index: CellIndex, k: int, max_distance: float) -> None:
    if k < 1:
        raise ValueError("k is at least 1")
    if not max_distance > 0:
        raise ValueError("the greatest distance is above 0")
    if index.copies is not None and k > index.copies:
        raise ValueError(f"the index keeps {index.copies} copies of equal vectors; fit it with copies >= {k}")


def _visited(index: CellIndex, tau: float):
    """Arrow function: vector to the cells on its side of the tree, and across boundaries within ``tau``."""
    tree, bundle_of = index.tree, index.bundle_of

    @F.arrow_udf(VISITS)
    def visits(features: pa.Array) -> pa.Array:
        points = block(features)
        return visits_in_steps(points, tree.cells, bundle_of, lambda lo, hi: tree.route(points[lo:hi], tau, "query"))

    return visits


def routed_queries(index: CellIndex, queries: DataFrame, tau: float | None = None) -> DataFrame:
    """``qid, features, bundle, cells``: the cells each query visits, more than one near a boundary (KNN4)."""
    return _routed(queries, _visited(index, index.tau if tau is None else tau)("features"))


def _best_first(index: CellIndex, probes: int):
    """Arrow function: vector to the ``probes`` cells of least margin."""
    tree, bundle_of = index.tree, index.bundle_of

    @F.arrow_udf(VISITS)
    def visits(features: pa.Array) -> pa.Array:
        points = block(features)
        return visits_in_steps(points, tree.cells, bundle_of, lambda lo, hi: tree.nearest_cells(points[lo:hi], probes)[:2])

    return visits


def probed_queries(index: CellIndex, queries: DataFrame, probes: int) -> DataFrame:
    """``qid, features, bundle, cells``: the ``probes`` cells that are best for each query (KNN4)."""
    return _routed(queries, _best_first(index, probes)("features"))


def probes_needed(index: CellIndex, asked: DataFrame, k: int, recall: float = DEFAULT_RECALL, max_distance: float = math.inf) -> int:
    """Cells a query ``(qid, features)`` has to visit for the wanted recall, from a sample of the queries (KNN8)."""
    rows = index.rows.select("tid", "features", F.array("cell_id").alias("cells"))
    if index.spill == "train":  # a row is kept in several cells, and any of them will do
        rows = index.rows.groupBy("tid").agg(F.first("features").alias("features"), F.collect_set("cell_id").alias("cells"))
    return calibrated_probes(rows, asked, index.tree.margins, index.tree.cells, k, recall, max_distance)


def visited_share(index: CellIndex, routed: DataFrame) -> float:
    """The share of all pairs of a query and a training row that a search of ``routed`` compares."""
    sizes = numbers_by(routed.select("qid", F.explode("cells").alias("cell_id")), "cell_id", index.sizes, "size", 0)
    pairs, asked = sizes.agg(F.sum("size"), F.count_distinct("qid")).first()
    return (pairs or 0) / max(1, asked * sum(index.sizes.values()))


def knn_cells(index: CellIndex, queries: DataFrame, id_col: str = "qid", features_col: str = "features",
              k: int = DEFAULT_K, max_distance: float = math.inf, tau: float | None = None, recall: float | None = None,
              probes: int | None = None) -> DataFrame:
    """Neighbours ``qid, tid, distance, rank, aux...`` among the visited cells; approximate unless tau is infinite.

    With ``tau`` a query visits both sides of the planes it is near to; with ``probes`` that many cells, the best first;
    with ``recall`` as many as a sample of the queries needs for it. If none is given, an index with a buffer size of its
    own uses that as tau, and any other meets ``DEFAULT_RECALL``.
    """
    _check_search(index, k, max_distance)
    asked = vector_rows(queries, id_col, features_col, (), "qid")
    if recall is None and tau is None and probes is None and index.estimated:
        recall = DEFAULT_RECALL
    if recall is not None and probes is None:
        probes = probes_needed(index, asked, k, recall, max_distance)
    visits = (_visited(index, index.tau if tau is None else tau) if probes is None else _best_first(index, probes))("features")
    if index.spill != "train":
        return _ranked(search_cells(index, asked, visits, k, max_distance), k)
    return _filled(index, asked, visits, k, max_distance)


def _once(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, where a training row may have been met in several cells; one shuffle, by query."""
    return _ranked(found.repartition("qid").dropDuplicates(["qid", "tid"]), k)


def _rows_visited(index: CellIndex):
    """Arrow function: visits to the number of rows kept in their cells."""
    sizes = np.array([index.sizes.get(c, 0) for c in range(index.tree.cells)])

    @F.arrow_udf("bigint")
    def rows_of(visits: pa.Array) -> pa.Array:
        cells = visits.flatten().field("cells")
        bundles = np.concatenate([[0], np.cumsum(np.diff(visits.offsets.to_numpy()))])
        ends = np.concatenate([[0], np.cumsum(np.diff(cells.offsets.to_numpy()))])[bundles]
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(sizes[cells.flatten().to_numpy()])])[ends]))

    return rows_of


def _filled(index: CellIndex, asked: DataFrame, visits: Column, k: int, max_distance: float) -> DataFrame:
    """Neighbours in cells with overlap, where queries that got fewer than ``k`` take the rest from cells further off.

    Queries whose cells hold fewer than ``k`` rows are not searched there in vain. The cells of nearest centre that hold
    enough rows are searched; copies of rows in several cells may leave a query short again, so the number of rows is
    doubled until all queries are served or every row is searched.
    """
    enough, total = 2 * k, sum(index.sizes.values())
    asked = materialise(asked.withColumn("held", _rows_visited(index)(visits)))
    served: list[DataFrame] = []
    short, hopeful = (asked.where(c).select("qid", "features") for c in (F.col("held") < k, F.col("held") >= k))
    if short.isEmpty() or not hopeful.isEmpty():
        found = materialise(_once(search_cells(index, hopeful, visits, k, max_distance), k))
        rest = _still_short(found, hopeful, k)
        served.append(_of_others(found, rest))
        short = materialise(short.unionByName(rest))
    while not short.isEmpty():
        if enough >= total:
            served.append(_of_all_rows(index, short, k, max_distance))
            break
        near = index.tree.neighbourhoods(index.sizes, enough)
        found = materialise(_once(search_cells(index, short, _nearby(index, near)("features"), k, max_distance), k))
        short = _still_short(found, short, k)
        served.append(_of_others(found, short))
        enough *= 2
    return functools.reduce(DataFrame.unionByName, served)


def _still_short(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    counts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return materialise(asked.join(counts, "qid", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n"))


def _of_others(found: DataFrame, short: DataFrame) -> DataFrame:
    """What is found for queries that are not short; only that is written down."""
    return found if short.isEmpty() else materialise(found.join(short.select("qid"), "qid", "left_anti"))


def _of_all_rows(index: CellIndex, asked: DataFrame, k: int, max_distance: float) -> DataFrame:
    """``qid, tid, distance, rank, aux...`` among all rows, each once.

    Where each query's neighbours fit a task and its id stands for one vector, as each row's does, they are ranked in the
    task that reads all rows, and no pair is shuffled; otherwise by a shuffle on the query.
    """
    kept = sum(index.sizes.values())
    if k < kept and index.rows.agg(F.count_distinct("cell_id", "tid")).first()[0] < kept:
        # a row that a cell holds twice takes two of the cell's k places
        everywhere = _nearby(index, index.tree.neighbourhoods(index.sizes, kept))
        return _once(search_cells(index, asked, everywhere("features"), k, max_distance), k)
    rows = materialise(index.rows.select("tid", "features", *index.aux).dropDuplicates(["tid", "features"]))
    asked = materialise(asked.dropDuplicates(["qid", "features"]))
    whole = single_cell(rows, aux=index.aux)
    count, queries, total, ids = *asked.agg(F.count(F.lit(1)), F.count_distinct("qid")).first(), *rows.agg(F.count(F.lit(1)), F.count_distinct("tid")).first()
    if count == queries and total == ids and min(k, total) <= STREAM_FOUND:
        found = streamed(whole, asked, _whole_visit(), k, max_distance, stream_parts(whole, count, total, k, count), ranked=True)
        return found.select("qid", "tid", "distance", *index.aux, "rank")
    return _once(search_cells(whole, asked, _whole_visit(), k, max_distance), k)


def _whole_visit() -> Column:
    """The visit to the only cell of an index without pruning."""
    return F.array(F.struct(F.lit(0).alias("bundle"), F.array(F.lit(0)).alias("cells")))


def knn_exact(train: DataFrame, queries: DataFrame, k: int = DEFAULT_K, max_distance: float = math.inf,
              aux: tuple[str, ...] = (), train_id: str = "tid", query_id: str = "qid",
              features_col: str = "features") -> DataFrame:
    """Exact neighbours by comparing every query with every training vector, block by block (KNN2)."""
    if k < 1 or not max_distance > 0:
        raise ValueError("k is at least 1 and the greatest distance above 0")
    index = single_cell(train, train_id, features_col, aux)
    asked = vector_rows(queries, query_id, features_col, (), "qid")
    return _ranked(search_cells(index, asked, _whole_visit(), k, max_distance), k)


def _reachable(index: CellIndex, near: list[np.ndarray]):
    """Arrow function: vector and bound to the cells that may hold a closer point, those searched first left out."""
    tree, bundle_of = index.tree, index.bundle_of
    centres = np.array(tree.centres)
    radius = np.array([index.radius.get(c, -math.inf) for c in range(tree.cells)])
    # pairs of a query and a cell at a time, each with a difference of vectors
    step = max(1, CHUNK_CELLS // (tree.cells * max(1, index.dimensions)))
    searched = np.unique(np.concatenate([c * tree.cells + cells for c, cells in enumerate(near)]))

    @F.arrow_udf(VISITS)
    def cells_within(features: pa.Array, bound: pa.Array) -> pa.Array:
        points = block(features)
        limit = bound.to_numpy(zero_copy_only=False)
        row, cell = tree.route(points)
        own = np.empty(len(points), int)
        own[row] = cell

        def within(start: int, end: int):
            rows, cells = [np.empty(0, int)], [np.empty(0, int)]
            for lo in range(start, min(end, len(points)), step):
                part, reach = points[lo : min(lo + step, end)], limit[lo : min(lo + step, end)]
                row, cell = tree.route_within(part, reach)
                away = np.sqrt(((part[row] - centres[cell]) ** 2).sum(axis=1))
                kept = away - radius[cell] <= reach[row] + SLACK * (1.0 + away)
                kept &= ~np.isin(own[lo + row] * tree.cells + cell, searched)
                rows.append(row[kept] + lo - start)
                cells.append(cell[kept])
            return np.concatenate(rows), np.concatenate(cells)

        return visits_in_steps(points, tree.cells, bundle_of, within)

    return cells_within


def _nearby(index: CellIndex, near: list[np.ndarray]):
    """Arrow function: vector to the cells that are searched first."""
    tree, bundle_of = index.tree, index.bundle_of

    @F.arrow_udf(VISITS)
    def cells_near(features: pa.Array) -> pa.Array:
        points = block(features)

        def around(lo: int, hi: int):
            row, cell = tree.route(points[lo:hi])
            lists = [near[c] for c in cell]
            cells = np.concatenate(lists) if lists else np.empty(0, int)
            return np.repeat(row, [len(c) for c in lists]), cells

        return visits_in_steps(points, tree.cells, bundle_of, around)

    return cells_near


def near_cells(index: CellIndex, k: int) -> list[np.ndarray]:
    """For each cell the cells to search first: itself, or more where it has too few rows for a useful bound."""
    return index.tree.neighbourhoods(index.sizes, FIRST_ROWS * k)


def bounded_queries(queries: DataFrame, bounds: DataFrame, max_distance: float = math.inf) -> DataFrame:
    """``qid, features, bound``: how far off a query's neighbours can still be."""
    return queries.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(max_distance)))


def knn_exact_pruned(index: CellIndex, queries: DataFrame, id_col: str = "qid", features_col: str = "features",
                     k: int = DEFAULT_K, max_distance: float = math.inf) -> DataFrame:
    """Exact neighbours that skip the cells which cannot hold one (KNN7).

    First each query searches its own cell, which bounds the distance of its k-th neighbour; then it visits only cells
    that neither a splitting plane nor the ball around the cell puts beyond that bound.
    """
    if index.spill == "train":
        raise ValueError("exact search needs cells without overlap")
    _check_search(index, k, max_distance)
    asked = vector_rows(queries, id_col, features_col, (), "qid")
    around = near_cells(index, k)
    near = _ranked(materialise(search_cells(index, asked, _nearby(index, around)("features"), k, max_distance)), k)
    bounds = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    bounds = bounds.select("qid", F.when(F.col("n") >= k, F.col("far")).alias("bound"))
    # cells beyond those searched first that a query's bound does not rule out
    bounded = materialise(bounded_queries(asked, bounds, max_distance))
    far = search_cells(index, bounded, _reachable(index, around)("features", "bound"), k, max_distance)
    return _ranked(near.drop("rank").unionByName(far), k)


def with_neighbors(queries: DataFrame, neighbours: DataFrame, id_col: str = "qid", aux: tuple[str, ...] = ("tid",),
                   neighbors_col: str = "neighbors", distance_col: str | None = None) -> DataFrame:
    """Add each query's neighbours as a list of structs, nearest first; no query is lost (KNN9, JOIN6)."""
    placed = F.array_sort(F.collect_list(F.struct("rank", "distance", F.struct(*aux).alias("row"))))
    lists = neighbours.groupBy("qid").agg(placed.alias("_found"))
    joined = queries.join(lists.withColumnRenamed("qid", id_col), id_col, "left")
    out = joined.withColumn(neighbors_col, F.coalesce(F.transform("_found", lambda n: n["row"]), F.array()))
    if distance_col:
        far = F.transform("_found", lambda n: n["distance"])
        out = out.withColumn(distance_col, F.coalesce(far, F.array().cast("array<double>")))
    return out.drop("_found")

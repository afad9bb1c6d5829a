"""Searches that read all rows are the same whatever the limits of a task, and shuffle no pairs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from test_knn import brute, frames, listed, points
from titlekit.knn import cells as cells_module
from titlekit.knn import search as search_module
from titlekit.knn.cells import fit_cells
from titlekit.knn.search import knn_cells, knn_exact, knn_exact_pruned


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_filling_from_all_rows_shuffles_no_pairs(spark):
    train, queries = points(150), points(12, seed=1)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, spill="train", top_tree_size=100, top_tree_leaf_size=5, buffer_size=0.2, balance_threshold=0.9)
    found = knn_cells(index, q, k=sum(index.sizes.values()))
    assert listed(found, queries) == brute(train, queries, 150)
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    near = knn_cells(index, q, k=1000, max_distance=1.0)
    assert listed(near, queries) == brute(train, queries, 1000, 1.0)


def test_repeated_ids_are_filled_too(spark):
    train, queries = points(60), points(6, seed=1)
    t, q = frames(spark, train + train[:7], queries + queries[:2])
    index = fit_cells(t, spill="train", top_tree_size=50, top_tree_leaf_size=5, buffer_size=0.2, balance_threshold=0.9)
    assert listed(knn_cells(index, q, k=300), queries) == brute(train, queries, 300)


def test_rows_and_queries_are_not_copied_for_each_other(spark, monkeypatch):
    """Blocks of rows are read by parts of queries instead of being shuffled to them; results and extra columns are the same."""
    monkeypatch.setattr(cells_module, "BLOCK_BYTES", 15 * 8 * 3)
    train, queries = points(200, copies=30), points(150, seed=1, copies=20)
    t, q = frames(spark, train, queries)
    t = t.withColumn("label", F.col("tid") * 2)
    for limit in (math.inf, 0.7):
        found = knn_exact(t, q, 4, max_distance=limit, aux=("label",))
        assert "CoGroup" not in plan(found)
        assert listed(found, queries) == brute(train, queries, 4, limit) and found.where("label != 2 * tid").count() == 0
    index = fit_cells(t, buffer_size=0.0, top_tree_size=60, copies=4)
    assert listed(knn_cells(index, q, k=4, tau=math.inf), queries) == brute(train, queries, 4)
    assert listed(knn_exact_pruned(index, q, k=4), queries) == brute(train, queries, 4)
    spilled = fit_cells(t, spill="train", buffer_size=0.3, top_tree_size=60, balance_threshold=0.9)
    assert listed(knn_cells(spilled, q, k=4, probes=spilled.tree.cells), queries) == brute(train, queries, 4)


def test_both_ways_of_a_search_agree(spark, monkeypatch):
    """Few cells of many: by a shuffle, and with a part's neighbours merged many times over."""
    train, queries = points(300, copies=40), points(80, seed=1)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, buffer_size=0.0, top_tree_size=300, copies=6)
    few = [sorted(map(str, knn_cells(index, q, k=6, probes=5).collect()))]
    monkeypatch.setattr(search_module, "_by_bundle", None)
    monkeypatch.setattr(search_module, "stream_parts", lambda *_: 3)
    monkeypatch.setattr(search_module, "TASK_FOUND", 50)
    monkeypatch.setattr(search_module, "task_parts", lambda *_: 10**6)  # what a shuffle would move
    few.append(sorted(map(str, knn_cells(index, q, k=6, probes=5).collect())))
    assert few[0] == few[1]

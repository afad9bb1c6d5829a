"""Searches that meet a recall, and indexes kept as tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import brute, frames, listed, points

from titlekit.knn import cells as cells_module
from titlekit.knn import search as search_module
from titlekit.knn import stored as stored_module
from titlekit.knn.cells import fit_cells
from titlekit.knn.estimators import KNN, KNNClassificationModel, KNNClassifier, KNNModel, KNNRegression, KNNRegressionModel
from titlekit.knn.probing import exact_of_sample, probes_for
from titlekit.knn.search import knn_cells, probed_queries, probes_needed, visited_share
from titlekit.knn.stored import beams, needed_probes, open_index, routed_rows, search_stored, store_index
from titlekit.knn.tree import PivotTree


def recall(got, want):
    return sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))


def test_margins_are_zero_in_the_own_cell_and_never_below_a_node():
    rng = np.random.default_rng(1)
    train, asked = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    tree = PivotTree()
    tree.grow(train, 10)
    margins = tree.margins(asked)
    row, cell = tree.route(asked)
    own = dict(zip(row, cell))
    assert all(margins[i, own[i]] == 0.0 and (margins[i] == 0.0).sum() == 1 for i in range(40))
    started = tree.margins(asked, np.full(40, 2.5))
    assert np.allclose(started, margins + 2.5)
    row, cell, margin = tree.nearest_cells(asked, 4)
    assert len(row) == 160 and np.allclose(margin.reshape(40, 4), np.sort(margins, axis=1)[:, :4])
    assert len(tree.nearest_cells(asked, 10**6)[0]) == 40 * tree.cells


def test_probes_for():
    assert probes_for([], 0.9, 7) == 1 and probes_for([[]], 0.9, 7) == 1
    assert probes_for([[1, 2], [1, 3]], 1.0, 9) == 3
    assert probes_for([[1] * 9 + [50]] * 100, 0.9, 99) == 1
    assert probes_for([[1] * 9 + [50]] * 100, 0.95, 99) == 50


@pytest.mark.parametrize("dims, wanted, spill", [(2, 0.9, "query"), (8, 0.99, "query"), (8, 0.9, "train")])
def test_the_wanted_recall_is_met(spark, dims, wanted, spill):
    train, queries = points(1500, dims=dims), points(400, dims=dims, seed=1, copies=30)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, spill=spill, buffer_size=0.05 if spill == "train" else -1.0)
    want = brute(train, queries, 5)
    assert recall(listed(knn_cells(index, q, k=5, recall=wanted), queries), want) >= wanted
    probes = probes_needed(index, q.selectExpr("qid", "features"), 5, wanted)
    share = visited_share(index, probed_queries(index, q, probes))
    assert probes <= index.tree.cells and (share < 0.5 if dims == 2 and spill == "query" else share <= 3)


def test_the_default_search_meets_nine_tenths(spark):
    train, queries = points(800, dims=6), points(200, dims=6, seed=1)
    t, q = frames(spark, train, queries)
    want = brute(train, queries, 5)
    index = fit_cells(t)
    assert index.estimated and recall(listed(knn_cells(index, q), queries), want) >= 0.9
    # a buffer size given at fitting is kept
    narrow = fit_cells(t, buffer_size=0.0)
    assert not narrow.estimated and recall(listed(knn_cells(narrow, q), queries), want) < 0.9
    model = KNN(k=5, idCol="tid", inputCols=["tid"]).fit(t)
    got = {r["tid"]: [n["tid"] for n in r["neighbors"]] for r in model.transform(q.withColumnRenamed("qid", "tid")).collect()}
    assert recall(got, want) >= 0.9
    with pytest.raises(ValueError):
        knn_cells(index, q, recall=0.0)
    with pytest.raises(ValueError):
        KNN(recall=1.5).fit(t)


def test_exact_neighbours_of_a_sample(spark):
    train, queries = points(500, dims=3, copies=40), points(10, dims=3, seed=2)
    t, _ = frames(spark, train, [])
    found = exact_of_sample(t.withColumn("cells", F.array(F.lit(0))), np.array([v for _, v in queries]), 5, 1.5).collect()
    got = {i: [] for i, _ in queries}
    for r in sorted(found, key=lambda r: (r["q"], r["distance"], r["tid"])):
        got[r["q"]].append(r["tid"])
    assert got == brute(train, queries, 5, 1.5)


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    train = points(1200, dims=3, copies=150)
    t, _ = frames(spark, train, [])
    t = t.withColumn("label", F.col("tid") % 3)
    folder = str(tmp_path_factory.mktemp("index") / "a")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stored_module, "SUBTREE_POINTS", 150)
        return train, t, store_index(t, folder, aux=("label",), max_cell_rows=40, limit=0)


def test_stored_cells(shelf):
    """Levels of subtrees; every row once; only the copies are more than a cell may have."""
    train, _, index = shelf
    assert index.levels >= 2 and index.total == 1200
    rows = index.rows.collect()
    assert sorted(r["tid"] for r in rows) == list(range(1200))
    sizes = index.rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("features").alias("d")).collect()
    assert all(r["n"] <= 40 or r["d"] == 1 for r in sizes)
    assert index.cells.agg(F.sum("n")).first()[0] == 1200


@pytest.mark.parametrize("limit", [0, stored_module.ROUTER_BYTES])
def test_tree_sent_or_met_by_a_shuffle(spark, shelf, limit):
    """Both ways lead every training row to its own cell, and every query to the same best cells."""
    train, t, index = shelf
    rows = t.select("tid", "features").withColumn("cell", F.lit(stored_module.ROOT).cast("bigint"))
    for level in range(index.levels):
        rows = routed_rows(rows, index.tree.where(F.col("level") == level), limit)
    got = {r["tid"]: r["cell"] for r in rows.collect()}
    assert got == {r["tid"]: r["cell_id"] for r in index.rows.select("tid", "cell_id").collect()}
    q = frames(spark, [], points(30, dims=3, seed=5))[1]
    one = {r["qid"]: [tuple(b) for b in r["beam"]] for r in beams(index, q, 6, 0).collect()}
    two = {r["qid"]: [tuple(b) for b in r["beam"]] for r in beams(index, q, 6).collect()}
    assert one == two and all(len(b) == 6 for b in one.values())
    every = {r["qid"]: [tuple(b) for b in r["beam"]] for r in beams(index, q, 10**6).collect()}
    assert all(every[i][:6] == one[i] and len(every[i]) == index.cells.count() for i in one)


def test_reopened_search_is_exact_in_all_cells(spark, shelf):
    train, _, index = shelf
    queries = points(60, dims=3, seed=1, copies=20)
    q = frames(spark, [], queries)[1]
    again = open_index(spark, index.folder)
    assert again.aux == ("label",) and again.levels == index.levels
    want = brute(train, queries, 5)
    found = search_stored(again, q, probes=again.cells.count())
    assert listed(found, queries) == want and all(r["label"] == r["tid"] % 3 for r in found.collect())
    assert recall(listed(search_stored(again, q, recall=0.9), queries), want) >= 0.9
    assert needed_probes(again, q, 5, 0.9) < again.cells.count()
    assert listed(search_stored(again, q, max_distance=0.5, probes=10**6), queries) == brute(train, queries, 5, 0.5)


def test_rows_are_not_shuffled(spark, shelf):
    _, _, index = shelf
    q = frames(spark, [], points(60, dims=3, seed=1))[1]
    plan = search_stored(open_index(spark, index.folder), q, probes=3)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FlatMapCoGroupsInArrow"):]
    rows = side[: side.index("FileScan parquet spark_catalog")]
    assert "Bucketed: true" in plan and "Exchange" not in rows.split("\n", 1)[1]


def test_hot_bundles_are_a_grid(spark, shelf, monkeypatch):
    train, _, index = shelf
    monkeypatch.setattr(stored_module, "TASK_PAIRS", 300)
    queries = points(80, dims=3, seed=1, copies=50)
    q = frames(spark, [], queries)[1]
    assert listed(search_stored(index, q, probes=10**6), queries) == brute(train, queries, 5)


def test_large_cells_are_blocks(spark, tmp_path, monkeypatch):
    for module in (cells_module, search_module):
        monkeypatch.setattr(module, "block_rows", lambda d: 25)
    monkeypatch.setattr(stored_module, "block_rows", lambda d: 25)
    train, queries = points(300, copies=120), points(20, seed=1)
    t, q = frames(spark, train, queries)
    index = store_index(t, str(tmp_path / "b"), max_cell_rows=60)
    assert index.cells.agg(F.max("blocks")).first()[0] > 1
    assert listed(search_stored(index, q, probes=10**6), queries) == brute(train, queries, 5)


def test_few_or_odd_rows(spark, tmp_path):
    t, q = frames(spark, [(1, [1.0, 2.0])], [(7, [0.0, 0.0])])
    index = store_index(t, str(tmp_path / "one"))
    assert index.levels == 0 and listed(search_stored(index, q), [(7, 0)]) == {7: [1]}
    none = q.where("qid < 0")
    assert search_stored(index, none).count() == 0
    with pytest.raises(ValueError):
        store_index(t.where("tid < 0"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        search_stored(index, q, k=0)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "tid long, features array<double>")
    with pytest.raises(ValueError):
        store_index(mixed, str(tmp_path / "mixed"))
    nulls = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "tid long, features array<double>")
    assert store_index(nulls, str(tmp_path / "nulls")).total == 1
    assert math.isclose(search_stored(index, q).first()["distance"], math.sqrt(5))


def test_neighbouring_cells_as_by_all_distances():
    """The groups of the tree give the lists that comparing all centres gives, ties included."""
    for n, dims, places in ((900, 2, 1), (600, 5, 9), (40, 3, 9)):
        rng = np.random.default_rng(n)
        rows = np.round(rng.normal(size=(n, dims)), places)
        tree = PivotTree()
        tree.grow(rows, 6)
        cell = tree.route(rows)[1]
        sizes = dict(zip(*np.unique(cell, return_counts=True)))
        centres, held = np.array(tree.centres), np.array([sizes.get(c, 0) for c in range(tree.cells)])
        assert sorted(tree.leaf_order()) == list(range(tree.cells))
        for enough in (1, 25, 10**6):
            for c, got in enumerate(tree.neighbourhoods(sizes, enough)):
                if held[c] >= enough:
                    assert got.tolist() == [c]
                    continue
                order = np.argsort(((centres - centres[c]) ** 2).sum(axis=1), kind="stable")
                count = np.searchsorted(np.cumsum(held[order]), enough) + 1
                assert got.tolist() == sorted(order[:count].tolist())


def test_models_on_an_index_in_a_folder(spark, tmp_path):
    """Fitted, and opened again with nothing but the folder."""
    train, queries = points(200), points(30, seed=1)
    t, q = frames(spark, train, queries)
    t = t.withColumn("label", (F.col("tid") % 3).cast("double"))
    asked, want = q.withColumnRenamed("qid", "tid"), brute(train, queries, 3)
    path = str(tmp_path / "k")
    fitted = KNN(k=3, idCol="tid", inputCols=["tid"], indexPath=path, exact=True).fit(t)
    again = KNNModel.opened(spark, path, k=3, idCol="tid", inputCols=["tid"], exact=True)
    for model in (fitted, again):
        assert {r["tid"]: [n["tid"] for n in r["neighbors"]] for r in model.transform(asked).collect()} == want
        model.release()
    path = str(tmp_path / "c")
    fitted = KNNClassifier(k=3, idCol="tid", indexPath=path, exact=True).fit(t)
    again = KNNClassificationModel.opened(spark, path, k=3, idCol="tid", exact=True)
    got = [{r["tid"]: (r["prediction"], r["probability"].toArray().tolist()) for r in m.transform(asked).collect()} for m in (fitted, again)]
    assert got[0] == got[1] and again.numClasses == 3
    path = str(tmp_path / "r")
    fitted = KNNRegression(k=3, idCol="tid", indexPath=path, exact=True).fit(t)
    again = KNNRegressionModel.opened(spark, path, k=3, idCol="tid", exact=True)
    means = {i: sum(t % 3 for t in near) / 3 for i, near in want.items()}
    for model in (fitted, again):
        assert {r["tid"]: pytest.approx(r["prediction"]) for r in model.transform(asked).collect()} == means


def test_every_cell_is_searched_without_a_beam(spark, shelf, monkeypatch):
    """A beam of all cells would grow with the queries times the cells."""
    train, _, index = shelf
    queries = points(20, dims=3, seed=1)
    q = frames(spark, [], queries)[1]
    cells = index.cells.count()
    near = listed(search_stored(index, q, probes=cells - 1), queries)
    monkeypatch.setattr(stored_module, "TASK_FOUND", 9)
    assert listed(search_stored(index, q, probes=cells - 1), queries) == near
    monkeypatch.setattr(stored_module, "beams", None)
    assert listed(search_stored(index, q, probes=cells), queries) == brute(train, queries, 5)


def test_rows_that_are_there_twice_count_once(spark, tmp_path):
    train, queries = points(40, dims=3), points(6, dims=3, seed=1)
    t, q = frames(spark, train + train[::3], queries)
    index = store_index(t, str(tmp_path / "twice"), max_cell_rows=5)
    assert listed(search_stored(index, q, probes=10**6), queries) == brute(train, queries, 5)

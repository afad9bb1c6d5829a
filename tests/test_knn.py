from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from titlekit.knn import cells as cells_module
from titlekit.knn import search as search_module
from titlekit.knn.cells import cell_boxes, farthest_point, fit_cells
from titlekit.knn.estimators import KNN, KNNClassifier, KNNRegression
from titlekit.knn.predict import class_count, classified, regressed, votes, winners
from titlekit.knn.search import knn_cells, knn_exact, knn_exact_pruned, with_neighbors
from titlekit.knn.tau import estimate_tau, sample_spacing, spacing_line, tau_from_line
from titlekit.knn.tree import PivotTree
from titlekit.knn.vectors import euclidean, nearest_in_block


def brute(train, queries, k, max_distance=math.inf):
    """Neighbours by plain numpy: {qid: [tid, ...]} ordered by distance, then id."""
    found = {}
    for qid, q in queries:
        near = sorted((math.sqrt(((np.array(q) - np.array(t)) ** 2).sum()), tid) for tid, t in train)
        found[qid] = [tid for d, tid in near if d <= max_distance][:k]
    return found


def listed(neighbours, queries):
    found = {qid: [] for qid, _ in queries}
    for r in neighbours.orderBy("qid", "rank").collect():
        found[r["qid"]].append(r["tid"])
    return found


def frames(spark, train, queries):
    return (
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in train], "tid long, features array<double>"),
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "qid long, features array<double>"),
    )


def points(n, dims=3, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims))
    if copies:
        rows[:copies] = rows[0]
    return [(i, row.tolist()) for i, row in enumerate(rows)]


def test_exact_with_ties_few_points_and_distance_limit(spark):
    train = [(1, [0, 0]), (2, [0, 0]), (3, [3, 4]), (0, [0, 0])]
    queries = [(10, [0, 0]), (11, [3, 4.5]), (12, [100, 100])]
    t, q = frames(spark, train, queries)
    for k in (2, 4, 9):
        assert listed(knn_exact(t, q, k), queries) == brute(train, queries, k)
    assert listed(knn_exact(t, q, 9, max_distance=5.0), queries) == brute(train, queries, 9, 5.0)


def test_a_third_of_the_points_equal(spark):
    """Copies beyond k never change a result, and the index does not keep them."""
    train, queries = points(300, copies=100), points(40, seed=1, copies=15)
    queries[0] = (0, train[0][1])
    t, q = frames(spark, train, queries)
    index = fit_cells(t, copies=4, buffer_size=0.0, top_tree_size=100)
    assert sum(index.sizes.values()) == 204
    assert listed(knn_exact_pruned(index, q, k=4), queries) == brute(train, queries, 4)
    with pytest.raises(ValueError):
        knn_exact_pruned(index, q, k=5)


@pytest.mark.parametrize("limit_pairs", [None, 500])
def test_hot_cells_are_searched_in_parts(spark, monkeypatch, limit_pairs):
    """With small block and task limits every cell is a grid of blocks and parts; results stay the same."""
    monkeypatch.setattr(cells_module, "BLOCK_BYTES", 20 * 8 * 3)
    if limit_pairs:
        monkeypatch.setattr(search_module, "TASK_PAIRS", limit_pairs)
    train, queries = points(200), points(150, seed=1, copies=60)
    t, q = frames(spark, train, queries)
    want = brute(train, queries, 5)
    assert listed(knn_exact(t, q, 5), queries) == want
    index = fit_cells(t, buffer_size=0.0, top_tree_size=40, max_cell_rows=10**6)
    assert max(index.blocks.values()) > 1
    assert listed(knn_exact_pruned(index, q, k=5), queries) == want
    assert listed(knn_cells(index, q, k=5, tau=math.inf), queries) == want


def test_crowded_cells_are_split_again(spark):
    train = points(600)
    t, _ = frames(spark, train, [])
    index = fit_cells(t, buffer_size=0.0, top_tree_size=30, sub_tree_leaf_size=5, max_cell_rows=50)
    assert max(index.sizes.values()) <= 50 and sum(index.sizes.values()) == 600
    same, _ = frames(spark, [(i, [1.0, 2.0]) for i in range(100)], [])
    assert fit_cells(same, buffer_size=0.0, max_cell_rows=10).sizes == {0: 100}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=40),
    asked=st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=8),
    k=st.integers(1, 4),
)
def test_pruned_search_is_exact(spark, data, asked, k):
    train, queries = list(enumerate(data)), list(enumerate(asked))
    t, q = frames(spark, train, queries)
    index = fit_cells(t, buffer_size=0.0, top_tree_leaf_size=2, copies=k)
    assert listed(knn_exact_pruned(index, q, k=k), queries) == brute(train, queries, k)
    index.release()


def test_recall_grows_with_tau(spark):
    train, queries = points(400, dims=4), points(60, dims=4, seed=1)
    t, q = frames(spark, train, queries)
    want = brute(train, queries, 5)
    index = fit_cells(t, buffer_size=0.0)
    hits = []
    for tau in (0.0, 0.3, 1.0, math.inf):
        got = listed(knn_cells(index, q, k=5, tau=tau), queries)
        hits.append(sum(len(set(got[i]) & set(want[i])) for i in want))
    assert hits == sorted(hits) and hits[-1] == 5 * 60


def test_spilled_cells_return_each_neighbour_once(spark):
    train, queries = points(300, dims=2), points(50, dims=2, seed=1)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, spill="train", buffer_size=0.4, top_tree_leaf_size=40)
    assert any(index.tree.overlapping) and sum(index.sizes.values()) > 300
    found = knn_cells(index, q, k=5)
    assert found.count() == found.dropDuplicates(["qid", "tid"]).count()
    got, want = listed(found, queries), brute(train, queries, 5)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.8 * 250
    with pytest.raises(ValueError):
        knn_exact_pruned(index, q)


def test_balance_rule_reverts_to_exclusive_nodes():
    spread = np.random.default_rng(0).normal(size=(200, 2))
    tree = PivotTree()
    tree.grow(spread, 20, tau=100.0, balance=0.7)
    assert not any(tree.overlapping)
    rows, _ = tree.route(spread, 100.0, "train")
    assert sorted(rows) == list(range(200))


def test_a_stored_index_finds_the_same(spark, tmp_path):
    train, queries = points(100), points(20, seed=1)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, buffer_size=0.0, store=str(tmp_path / "cells"))
    assert listed(knn_exact_pruned(index, q, k=3), queries) == brute(train, queries, 3)


def test_block_search_with_equal_and_distant_points():
    block = np.array([[1e6, 1e6], [1e6, 1e6], [1e6 + 1e-3, 1e6], [0.0, 0.0]])
    q, p, d = nearest_in_block(np.array([[1e6, 1e6]]), block, np.array([7, 3, 1, 0]), 3, math.inf)
    assert p.tolist() == [1, 0, 2] and d[:2].tolist() == [0.0, 0.0] and d[2] == pytest.approx(1e-3, rel=1e-6)


def test_rows_without_vector(spark):
    train = spark.createDataFrame([(1, [0.0]), (2, None), (3, [5.0])], "tid long, features array<double>")
    asked = spark.createDataFrame([(1, [4.0]), (2, None)], "qid long, features array<double>")
    found = knn_exact(train, asked, 5)
    assert listed(found, [(1, 0), (2, 0)]) == {1: [3, 1], 2: []}
    lists = with_neighbors(asked, found, distance_col="distances").orderBy("qid").collect()
    assert [len(r["neighbors"]) for r in lists] == [2, 0] and lists[0]["distances"] == [1.0, 4.0] and lists[1]["distances"] == []


def test_tau(spark):
    t, _ = frames(spark, points(800, dims=2), [])
    assert 0.0 < estimate_tau(t, sizes=(50, 100, 200, 400)) < 1.0
    same, _ = frames(spark, [(i, [1.0, 1.0]) for i in range(50)], [])
    assert estimate_tau(same, sizes=(10, 20)) == 0.0
    spacing = spark.createDataFrame([(0, 100, 1.0), (1, 200, 2.0)], "sample int, n long, spacing double")
    assert tau_from_line(spacing_line(spacing), 1000).first()["tau"] == 2.0
    falling = spark.createDataFrame([(0, 100, 2.0), (1, 400, 1.0)], "sample int, n long, spacing double")
    assert tau_from_line(spacing_line(falling), 1600).first()["tau"] == pytest.approx(0.5 / math.sqrt(2))


def test_sample_spacing(spark):
    t, _ = frames(spark, [(0, [0.0]), (1, [0.0]), (2, [3.0])], [])
    row = sample_spacing(t, sizes=(100,)).first()
    assert (row["n"], row["spacing"]) == (3, 3.0)


def test_boxes_and_farthest_point(spark):
    rows = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, [2.0, 4.0]), (1, 3, [5.0, 5.0])], "cell_id int, tid long, features array<double>")
    boxes = {r["cell_id"]: (r["centre"], r["radius"]) for r in cell_boxes(rows).collect()}
    assert boxes == {0: ([1.0, 2.0], math.sqrt(20) / 2), 1: ([5.0, 5.0], 0.0)}
    assert farthest_point(rows, 1).first().asDict() == {"tid": 3, "distance": math.sqrt(50)}


def test_distance_column(spark):
    row = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>").select(euclidean("a", "b")).first()
    assert row[0] == 5.0


NEIGHBOURS = "qid long, tid long, distance double, label double, weight double"


def test_votes(spark):
    near = spark.createDataFrame(
        [(1, 1, 0.0, 2.0, 1.0), (1, 2, 0.0, 0.0, 1.0), (2, 1, 0.0, 1.0, 3.0), (2, 2, 0.0, 2.0, 2.0), (2, 3, 0.0, 2.0, 2.0), (3, 1, 0.0, 1.0, 0.0)],
        NEIGHBOURS,
    )
    assert {r["qid"]: r["prediction"] for r in winners(votes(near)).collect()} == {1: 0.0, 2: 2.0, 3: 1.0}
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    out = {r["qid"]: r for r in classified(asked, near, 3, weight_col="weight").collect()}
    assert out[1]["raw"] == [1.0, 0.0, 1.0] and out[1]["probability"] == [0.5, 0.0, 0.5] and out[1]["prediction"] == 0.0
    assert out[2]["raw"] == [0.0, 3.0, 4.0] and out[2]["prediction"] == 2.0
    assert out[3]["prediction"] is None and out[4]["raw"] is None
    means = {r["qid"]: r["prediction"] for r in regressed(asked, near, weight_col="weight").collect()}
    assert means == {1: 1.0, 2: pytest.approx(11 / 7), 3: None, 4: None}


@pytest.mark.parametrize("bad", [-1.0, 0.5, None])
def test_labels_are_checked(spark, bad):
    rows = spark.createDataFrame([(0.0,), (2.0,), (bad,)], "label double")
    with pytest.raises(ValueError):
        class_count(rows)
    assert class_count(rows.where("label >= 0 and label = floor(label)")) == 3


@pytest.fixture(scope="module")
def vector_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, Vectors.dense(rng.normal(size=2) + (i % 2) * 6), float(i % 2), 1.0 + i % 3) for i in range(80)]
    return spark.createDataFrame(rows, ["key", "features", "label", "weight"])


def test_estimator_without_a_key(vector_rows):
    model = KNN(k=3, inputCols=["key", "label"], distanceCol="distances", bufferSize=0.0, exact=True).fit(vector_rows)
    out = model.transform(vector_rows.select("key", "features"))
    assert out.columns == ["key", "features", "neighbors", "distances"]
    for row in out.collect():
        assert row["neighbors"][0]["key"] == row["key"] and row["distances"] == sorted(row["distances"]) and len(row["distances"]) == 3
    model.release()


def test_classifier(vector_rows):
    model = KNNClassifier(k=5, idCol="key", weightCol="weight", bufferSize=0.0).fit(vector_rows)
    out = model.transform(vector_rows.select("key", "features", F.col("label").alias("truth"))).collect()
    assert all(r["prediction"] == r["truth"] and len(r["probability"]) == 2 and sum(r["probability"]) == pytest.approx(1) for r in out)
    assert model.numClasses == 2 and model.copy().numClasses == 2


def test_regression(spark, vector_rows):
    model = KNNRegression(k=5, idCol="key", bufferSize=0.0, exact=True).fit(vector_rows)
    out = model.transform(vector_rows.select("key", "features", F.col("label").alias("truth"))).collect()
    assert all(r["prediction"] == pytest.approx(r["truth"]) for r in out)
    assert model.predict(spark, [6.0, 6.0]) == 1.0 and model.predict(spark, Vectors.dense([0.0, 0.0])) == 0.0
    model.set("maxDistance", 0.01)
    assert model.predict(spark, [100.0, 100.0]) is None


def test_defaults():
    knn = KNN()
    values = {p.name: knn.getOrDefault(p) for p in knn.params if knn.hasDefault(p)}
    wanted = {"k": 5, "topTreeSize": 1000, "topTreeLeafSize": 10, "subTreeLeafSize": 30, "bufferSize": -1.0, "balanceThreshold": 0.7}
    assert wanted.items() <= values.items() and values["maxDistance"] == math.inf
    assert values["bufferSizeSampleSizes"] == list(range(100, 1001, 100))


def test_a_task_holds_a_bounded_part(spark, monkeypatch):
    """Queries, pairs and results of a task are bounded, whatever k and however many queries a cell draws."""
    for asked, rows, k in ((600_000, 600_000, 5), (600_000, 3_000, 5), (12_000, 50_000, 600_000), (2_000_000, 10, 10**9)):
        part = -(-asked // search_module.task_parts(asked, rows, k, 64))
        held = min(rows, cells_module.block_rows(64))
        assert max(part, held) * 64 * 8 <= 8 << 20
        assert part * held <= search_module.TASK_PAIRS and part * min(k, held) <= search_module.TASK_FOUND + held
    monkeypatch.setattr(search_module, "TASK_FOUND", 40)
    monkeypatch.setattr(search_module, "VISITS_AT_ONCE", 7)
    train, queries = points(120), points(40, seed=1)
    t, q = frames(spark, train, queries)
    index = fit_cells(t, buffer_size=0.0, top_tree_size=40, spill="train")
    assert listed(knn_cells(index, q, k=120), queries) == brute(train, queries, 120)
    index = fit_cells(t, buffer_size=0.0, top_tree_size=40)
    assert listed(knn_exact_pruned(index, q, k=30), queries) == brute(train, queries, 30)
    assert listed(knn_cells(index, q, k=30, tau=math.inf), queries) == brute(train, queries, 30)

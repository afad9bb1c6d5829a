"""Trees grown of all rows are the same whatever the driver holds, and however many rows are equal."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from oracle import compare
from test_knn import frames, points
from titlekit.knn import cells as cells_module
from titlekit.knn.cells import fit_cells
from titlekit.queries import ORACLES, QUERIES


def trees(t, **options):
    tree = fit_cells(t, **options).tree
    return [np.array(x).tolist() for x in (tree.left_pivot, tree.right_pivot, tree.children, tree.overlapping, tree.centres)]


@pytest.mark.parametrize("options", [{}, {"spill": "train", "balance_threshold": 0.9}, {"top_tree_depth": 1, "copies": 2}, {"top_tree_size": 150}])
def test_a_tree_does_not_depend_on_what_the_driver_holds(spark, monkeypatch, options):
    t, _ = frames(spark, points(220, copies=30), [])
    options = {"top_tree_size": None, "top_tree_leaf_size": 60, "buffer_size": 0.1, "max_cell_rows": math.inf} | options
    whole = trees(t, **options)
    assert len(whole[2]) >= 1
    monkeypatch.setattr(cells_module, "SAMPLE_BYTES", 70 * 8 * 3)
    assert trees(t, **options) == whole


@pytest.mark.parametrize("name", ["knn4_agg6_one_split", "knn5_one_split_spilled", "knn4_routed_queries"])
@pytest.mark.parametrize("held", [1000, 64])
def test_one_split_of_any_table(spark, tmp_path, monkeypatch, name, held):
    """The split is the SQL's for a table with many equal vectors, and for one that the driver does not hold."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(240)]
    rows = [(i, rows[3][1] if i < 20 else v, label) for i, v, label in rows]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    monkeypatch.setattr(cells_module, "SAMPLE_BYTES", held * 8 * 4)
    said = compare(spark, con, str(tmp_path), QUERIES[name], ORACLES[name])
    assert said.startswith("ok"), said

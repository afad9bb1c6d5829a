"""Odd vectors, parameters, repeated keys, and results that do not depend on limits of size."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from titlekit.functions.text import short_phrases
from titlekit.knn import cells, search
from titlekit.knn.cells import fit_cells
from titlekit.knn.estimators import KNN, KNNClassifier, KNNRegression
from titlekit.knn.search import knn_cells, knn_exact, knn_exact_pruned
from titlekit.knn.tree import PivotTree
from titlekit.knn.vectors import block
from titlekit.operators.containment import parts_of
from titlekit.plans import predict as plan
from titlekit.plans.model import dealt, term_stages, train_term_model, without_stop_words
from titlekit.plans.predict import predict, predict_titles
from titlekit.sources.titles import read_labelled
from titlekit.streaming.predict import predict_stream, read_stream


def points(spark, n, dimensions=3, seed=1):
    random = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in random.normal(size=dimensions)], float(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "tid bigint, features array<double>, label double")


def test_vectors_of_unequal_length_are_refused():
    for rows in ([[1.0], [2.0, 3.0, 4.0]], [[1.0, 2.0], [3.0, None]]):
        with pytest.raises(ValueError):
            block(pa.array(rows, pa.list_(pa.float64())))
    tree = PivotTree()
    tree.grow(np.zeros((1, 3)), 1)
    with pytest.raises(ValueError):
        tree.route(np.zeros((2, 2)))


def test_queries_of_another_length_are_refused(spark):
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "qid bigint, features array<double>")
    with pytest.raises(PythonException):
        knn_exact(points(spark, 5), queries, 2).collect()


def test_the_bound_pass_stays_small(spark):
    """150 cells in 768 dimensions, nothing ruled out: differences of vectors are formed in bounded pieces."""
    random = np.random.default_rng(2)
    tree = PivotTree()
    tree.grow(random.normal(size=(600, 768)), 6)
    index = cells.CellIndex(tree, 0.0, "query", None, {}, {c: 1e9 for c in range(tree.cells)}, np.zeros(tree.cells, int), {}, (), 768, None)
    near = [np.array([c]) for c in range(tree.cells)]
    function = search._reachable(index, near).func
    vectors = pa.array(list(random.normal(size=(400, 768))), pa.list_(pa.float64()))
    tracemalloc.start()
    function(vectors, pa.array(np.full(400, 1e9)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 << 20


def test_wide_vectors_are_not_refused(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE_BYTES", 40_000)
    train = points(spark, 400, 100)
    index = fit_cells(train, max_cell_rows=40, buffer_size=0.0)
    assert max(index.sizes.values()) <= 40
    queries = train.select(F.col("tid").alias("qid"), "features").where("qid < 20")
    one, two = (sorted(map(str, x.select("qid", "tid", "rank").collect())) for x in (knn_exact_pruned(index, queries, k=4), knn_exact(train, queries, 4)))
    assert one == two


def test_cells_are_split_until_none_is_crowded(spark):
    rows = points(spark, 600).unionByName(spark.range(1000, 1200).selectExpr("id AS tid", "array(9.0D, 9.0D, 9.0D) AS features", "0.0D AS label"))
    index = fit_cells(rows, max_cell_rows=25, top_tree_size=4, top_tree_leaf_size=2, sub_tree_leaf_size=3, buffer_size=0.0)
    crowded = {c: n for c, n in index.sizes.items() if n > 25}
    assert list(crowded.values()) in ([200], [201], [202]) or len(crowded) == 1  # equal vectors cannot be told apart


def test_spilled_cells_are_filled(spark):
    rows = points(spark, 200)
    index = fit_cells(rows, spill="train", top_tree_size=200, top_tree_leaf_size=3, buffer_size=0.1, balance_threshold=0.9)
    found = knn_cells(index, rows.select(F.col("tid").alias("qid"), "features"), k=12)
    counts = {r["n"] for r in found.groupBy("qid").agg(F.count_distinct("tid").alias("n")).collect()}
    assert counts == {12}
    near = knn_cells(index, rows.select(F.col("tid").alias("qid"), "features").limit(3), k=500, max_distance=0.5)
    assert near.where("distance > 0.5").count() == 0


@pytest.mark.parametrize("bad", [{"k": 0}, {"maxDistance": 0.0}, {"bufferSize": -0.5}, {"bufferSizeSampleSizes": [5]}, {"bufferSizeSampleSizes": [0, 5]}, {"balanceThreshold": 2.0}, {"spill": "both"}, {"topTreeLeafSize": 0}, {"copies": -1}])
def test_values_are_checked(spark, bad):
    with pytest.raises(ValueError):
        KNN(idCol="tid", **bad).fit(points(spark, 5))


def test_functions_check_values(spark):
    rows = points(spark, 5)
    queries = rows.select(F.col("tid").alias("qid"), "features")
    index = fit_cells(rows, buffer_size=0.0)
    for call in (lambda: knn_cells(index, queries, k=0), lambda: knn_exact(rows, queries, 0), lambda: knn_exact_pruned(index, queries, max_distance=-1.0), lambda: fit_cells(rows, balance_threshold=-1.0)):
        with pytest.raises(ValueError):
            call()


def test_k_is_raised_after_fitting(spark):
    rows = points(spark, 30).unionByName(points(spark, 30).withColumn("tid", F.col("tid") + 100))
    model = KNN(idCol="tid", k=1, inputCols=["tid", "features"], exact=True, bufferSize=0.0).fit(rows)
    out = model.set("k", 7).transform(rows)
    assert out.columns == ["tid", "features", "label", "neighbors"]
    assert {len(r["neighbors"]) for r in out.collect()} == {7}
    few = KNN(idCol="tid", k=2, copies=2, exact=True, bufferSize=0.0).fit(rows)
    with pytest.raises(ValueError):
        few.set("k", 3).transform(rows).collect()


def test_columns_without_a_name_are_left_out(spark):
    rows = points(spark, 20)
    options = {"idCol": "tid", "k": 3, "exact": True, "bufferSize": 0.0}
    out = KNNClassifier(rawPredictionCol="", probabilityCol="", **options).fit(rows).transform(rows)
    assert out.columns == ["tid", "features", "label", "prediction"]
    out = KNNClassifier(predictionCol="", probabilityCol="", **options).fit(rows).transform(rows)
    assert out.columns == ["tid", "features", "label", "rawPrediction"]
    assert dict(out.dtypes)["rawPrediction"] == "vector"
    assert KNNRegression(predictionCol="", **options).fit(rows).transform(rows).columns == rows.columns


def test_files_with_another_order_of_columns_are_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("product_name,core_terms,brand,stop_words\nred shoe,shoe,acme,red\n")
    (folder / "b.csv").write_text("product_name,core_terms,brand,stop_words\nblue shoe,shoe,acme,blue\n")
    assert read_labelled(spark, str(folder / "*.csv")).count() == 2
    (folder / "c.csv").write_text("brand,product_name,core_terms,stop_words\nacme,red hat,hat,red\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_labelled(spark, str(folder / "*.csv")).collect()


def test_blanks_at_the_end_make_no_word(spark):
    row = spark.createDataFrame([(["a b c ", "a b c d", "A  "],)], "p array<string>").select(short_phrases("p").alias("p")).first()
    assert row["p"] == ["a b c ", "a  "]


def test_only_lengths_that_occur(spark):
    row = spark.createDataFrame([("abcd ef",)], "t string").select(parts_of(F.col("t"), False, [2, 9]).alias("a"), parts_of(F.col("t"), True, [1]).alias("b"), parts_of(F.col("t"), False, []).alias("c")).first()
    assert row["a"] == ["ab", "bc", "cd", "d ", " e", "ef"] and row["b"] == ["abcd", "ef"] and row["c"] == []


def titles(spark):
    rows = [(i, f"{c} shoe acme{i}", "shoe" if i % 2 else "hat", "acme", "red") for i, c in enumerate(["red", "blue", "green", "red", "pink", "grey"])]
    return spark.createDataFrame(rows, "id bigint, product_name string, core_terms string, brand string, stop_words string")


def test_folds_are_never_empty(spark):
    rows = spark.createDataFrame([(f"t{i % 3}", i) for i in range(9)], "title string, n int")
    placed, folds = dealt(rows, "title", 10)
    assert folds == 3 and placed.count() == 9
    assert placed.groupBy("title").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r["n"] for r in placed.groupBy("fold").agg(F.count_distinct("title").alias("n")).collect()} == {1}


@pytest.mark.parametrize("vectors", ["counts", "hashed"])
def test_stop_words_go_in_training_and_in_prediction(spark, vectors):
    from titlekit.operators.training import training_features

    features = training_features(titles(spark), keep=("title",)).where("target is not null")
    fitted = train_term_model(features, folds=2, num_trees=2, vectors=vectors)
    assert [r["word"] for r in fitted.stop_words.collect()] == ["red"]
    seen = spark.createDataFrame([(1, ["Red", "shoe", "red shoe"]), (2, []), (3, ["red"])], "id bigint, tokens array<string>")
    left = {r["id"]: r["tokens"] for r in without_stop_words(seen, fitted.stop_words).collect()}
    assert left == {1: ["shoe", "red shoe"], 2: [], 3: []}


def test_no_token_is_left_out(spark):
    rows = spark.createDataFrame([([f"t{i}" for i in range(500)], 0.0), (["x"], 1.0)], "tokens array<string>, label double")
    assert len(term_stages(2).fit(rows).stages[1].vocabulary) == 501
    assert len(term_stages(2, vocab_size=7).fit(rows).stages[1].vocabulary) == 7


def lookups(spark):
    terms = spark.createDataFrame([(0, "shoe"), (1, "hat")], "label_index bigint, term string")
    return terms, spark.createDataFrame([("shoe", "acme"), ("hat", "best")], "term string, brand string")


def test_repeated_and_null_ids_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "acme shoe"), (1, "best hat"), (None, "a shoe"), (None, "the hat"), (2, None)], "id bigint, product_name string")
    got = sorted((str(r["id"]), str(r["product_name"]), *r["core_terms"], *r["brands"]) for r in predict(rows, "id", None, *lookups(spark)).collect())
    assert got == [("1", "acme shoe", "shoe", "acme"), ("1", "best hat", "hat", "best"), ("2", "None"), ("None", "a shoe", "shoe"), ("None", "the hat", "hat")]


def test_repeats_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([("acme shoe",)] * 11 + [("hat",)] * 2 + [(None,)] * 3, "product_name string")
    want = sorted(map(str, predict_titles(rows, None, *lookups(spark)).collect()))
    monkeypatch.setattr(plan, "REPEAT_ROWS", 4)
    assert sorted(map(str, predict_titles(rows, None, *lookups(spark)).collect())) == want and len(want) == 16


def test_no_cache_is_left(spark):
    def kept():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before = kept()
    predict_titles(spark.createDataFrame([("hat",)], "product_name string"), None, *lookups(spark)).collect()
    predict(spark.createDataFrame([(1, "hat")], "id bigint, product_name string"), "id", None, *lookups(spark)).collect()
    assert kept() == before


def test_stream_without_a_key(spark, tmp_path):
    rows = spark.createDataFrame([("acme shoe",), ("acme shoe",), (None,), ("hat",)], "product_name string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    terms, brands = lookups(spark)
    want = sorted(map(str, predict_titles(rows, None, terms, brands).collect()))
    for n in (1, 2):  # a new checkpoint does not touch what is there
        stream = read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
        predict_stream(stream, None, None, terms, brands, str(tmp_path / "out"), str(tmp_path / f"progress{n}")).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out")).select("product_name", "core_terms", "brands")
        assert sorted(map(str, found.collect())) == sorted(want * n)

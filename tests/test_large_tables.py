"""Steps whose size follows the input are neither sent through the driver nor left to a few tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlekit.operators.counts import count_vectors
from titlekit.operators.gazetteer import known_terms
from titlekit.operators.training import without_corpus_words
from titlekit.plans import model as plan
from titlekit.queries.model import hashed_counts


def written_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_all_rows_are_not_broadcast(spark):
    titles = spark.createDataFrame([(1, ["red", "Hot", "pan"]), (2, ["hot"])], "id bigint, tokens array<string>")
    words = spark.createDataFrame([("hot",)], "word string")
    kept = without_corpus_words(titles, "id", "tokens", words, "kept")
    assert "SortMergeJoin [id" in written_plan(kept)
    assert {r["id"]: r["kept"] for r in kept.collect()} == {1: ["red", "pan"], 2: []}
    found = known_terms(titles, "id", "tokens", spark.createDataFrame([("pan",)], "term string"))
    assert "SortMergeJoin [id" in written_plan(found)
    counted = count_vectors(titles, "id", "tokens", spark.createDataFrame([(0, "red")], "index bigint, token string"))
    assert "SortMergeJoin [id" in written_plan(counted)


def test_bucket_counts_are_not_broadcast(spark, tmp_path):
    part = [(1, "red pan", "Brand#1", "STEEL"), (2, "red red cup", "Brand#2", "TIN"), (None, None, None, None)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    found = hashed_counts(spark, str(tmp_path))
    text = written_plan(found)
    assert "SortMergeJoin [id" in text and "vector_to_array" not in text
    rows = {r["token"]: r for r in found.collect()}
    assert rows["red"]["total"] == 3.0 and rows["red"]["titles"] == 2 and rows["red red cup"]["total"] == 1.0
    assert all(r["one_bucket"] for r in rows.values())


def test_training_rows_are_dealt_to_tasks(spark, monkeypatch):
    rows = spark.range(400).select("id", F.array(F.concat(F.lit("t"), F.col("id") % 50)).alias("tokens")).coalesce(1)
    assert plan.dealt_to_tasks(rows, 8) is rows
    monkeypatch.setattr(plan, "FEW_ROWS", 10)
    monkeypatch.setattr(plan, "TASK_BYTES", 50 * (4 * 50 + 4 * 8 + plan.ROW_BYTES))
    for width in (None, 50):
        dealt = plan.dealt_to_tasks(rows, 8, width)
        parts = [len(p) for p in dealt.select("id").rdd.glom().collect()]
        assert max(parts) <= 60 and sorted(r["id"] for r in dealt.collect()) == list(range(400))
    assert plan.dealt_to_tasks(rows, 8, 10**6).rdd.getNumPartitions() == 400
    assert plan.dealt_to_tasks(rows.limit(0), 8).count() == 0

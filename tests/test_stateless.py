"""The stateless stream, vocabularies as tables, and filters inside lists."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from titlekit.operators import membership
from titlekit.operators.containment import minimal_lists
from titlekit.operators.counts import as_vector, count_vectors, fit_vocabulary
from titlekit.operators.gazetteer import known_terms, term_hits
from titlekit.operators.membership import maybe_among
from titlekit.plans import model as model_module
from titlekit.plans.model import dealt, indexed, out_of_fold, term_stages, without_stop_words
from titlekit.plans.predict import predict, predict_job
from titlekit.plans.train import train, train_job
from titlekit.streaming import stateless
from titlekit.streaming.predict import read_stream
from titlekit.streaming.stateless import predict_rows_stream, predicted_rows

LABELLED = "product_name string, core_terms string, brand string, stop_words string"


@pytest.fixture(scope="module")
def trained(spark):
    rows = []
    for i in range(30):
        rows.append((f"red jam tangan {i} casio", "jam tangan, jam", "casio", "red"))
        rows.append((f"Blue shirt cotton {i} uniqlo", "shirt", "uniqlo, gap", None))
    return train(spark.createDataFrame(rows, LABELLED), folds=2, num_trees=4)


TITLES = ["Red jam tangan casio", "shirt by gap and uniqlo", "shirt by gap and uniqlo", None, "", "nothing known", "jam gap", "SHIRT jam tangan uniqlo casio"]


def listed(df):
    return sorted(((r["id"], r["product_name"], tuple(r["core_terms"]), tuple(r["brands"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("with_model", [False, True])
def test_rows_equal_the_batch_plan(spark, trained, tmp_path, with_model):
    titles = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(TITLES * 4)], "id long, product_name string")
    model = trained.term_model.model if with_model else None
    words = trained.term_model.stop_words if with_model else None
    want = listed(predict(titles, "id", model, trained.terms, trained.brands, stop_words=words))
    assert any(t and b for _, _, t, b in want)
    assert listed(predicted_rows(titles, model, trained.terms, trained.brands, stop_words=words)) == want

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    titles.repartition(3).write.parquet(source)
    stream = read_stream(spark, source, titles.schema, files_per_batch=1)
    started = predict_rows_stream(stream, model, trained.terms, trained.brands, out, str(tmp_path / "progress"), stop_words=words)
    started.awaitTermination()
    assert listed(spark.read.parquet(out)) == want
    batches = [p for p in started.recentProgress if p["numInputRows"]]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(started.runId))
    assert len(batches) == 3 and len(jobs) == 3


def test_no_join_and_no_shuffle(spark, trained):
    titles = spark.createDataFrame([("a b",)], "product_name string")
    plan = predicted_rows(titles, trained.term_model.model, trained.terms, trained.brands)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_large_tables_are_refused(spark, trained, monkeypatch):
    monkeypatch.setattr(stateless, "fits_broadcast", lambda table: False)
    with pytest.raises(ValueError):
        predicted_rows(spark.createDataFrame([("a",)], "product_name string"), None, trained.terms, trained.brands)


def test_words_pass_the_filter(spark):
    words = spark.createDataFrame([(f"word {i}",) for i in range(3000)], "word string")
    small, test = maybe_among(words)
    assert small and words.where(test(F.col("word"))).count() == 3000
    others = spark.range(20000).select(F.concat(F.lit("other "), "id").alias("word"))
    assert others.where(test(F.col("word"))).count() < 600
    assert maybe_among(words, max_rows=2999) == (False, None) and maybe_among(words, max_bytes=1000) == (False, None)
    small, test = maybe_among(words.where("false"))
    assert small and others.where(test(F.col("word"))).count() == 0


@pytest.mark.parametrize("rows", [10**6, 1])
def test_hits_by_both_ways(spark, monkeypatch, rows):
    monkeypatch.setattr(membership.maybe_among, "__defaults__", (rows, 64 << 20))
    titles = spark.createDataFrame([(1, ["b", "x", "a", "b", None]), (2, []), (3, None), (4, ["y"])], "id long, tokens array<string>")
    terms = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "term string")
    assert {r["id"]: r["terms"] for r in known_terms(titles, "id", "tokens", terms).collect()} == {1: ["b", "a"], 2: [], 3: [], 4: []}
    plan = term_hits(titles, "id", "tokens", terms)._jdf.queryExecution().optimizedPlan().toString()
    assert ("substring" in plan) == (rows > 1)


@pytest.mark.parametrize("most", [100_000, 0])
def test_stop_words_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(model_module, "STOP_WORD_ROWS", most)
    titles = spark.createDataFrame([(1, ["Hot", "b", "hot b", "b", "HOT"]), (2, []), (3, ["hot"]), (3, ["c"])], "id long, tokens array<string>")
    words = spark.createDataFrame([("hOt",), ("z",), ("hOt",)], "word string")
    got = sorted((r["id"], r["tokens"]) for r in without_stop_words(titles, words).collect())
    assert got == [(1, ["b", "hot b", "b"]), (2, []), (3, []), (3, ["c"])]
    assert without_stop_words(titles, words.where("false")).count() == 4
    if most:
        assert "Exchange" not in without_stop_words(titles, words)._jdf.queryExecution().executedPlan().toString()


def test_count_vectors(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, []), (3, None), (4, ["b", "new"])], "id long, tokens array<string>")
    vocabulary = fit_vocabulary(rows.where("id < 4"))
    assert sorted(tuple(r) for r in vocabulary.collect()) == [(0, "a", 2), (1, "b", 1)]
    assert [r["token"] for r in fit_vocabulary(rows, min_df=2).collect()] == ["b"]
    held = count_vectors(rows, "id", "tokens", vocabulary).select("id", vector_to_array(as_vector("counts", 2)).alias("v"))
    assert {r["id"]: r["v"] for r in held.collect()} == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 1.0]}


def test_out_of_fold(spark):
    """Every row once, by a model that has not seen its fold: a mark that stands in one fold only is never learned."""
    rows = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], ["x", "m" + "ab"[i % 2]]) for i in range(60)], "id long, title string, target string, tokens array<string>")
    labelled, _ = indexed(rows)
    parted, folds = dealt(labelled, "title", 3)
    parted = parted.cache()
    scored = out_of_fold(parted, term_stages(10), folds, ("id",)).collect()
    assert sorted(r["id"] for r in scored) == list(range(60)) and all(r["label"] == r["prediction"] for r in scored)
    single = parted.withColumn("tokens", F.when(F.col("fold") == 0, F.array(F.concat(F.lit("only"), "target"))).otherwise(F.array(F.lit("x"))))
    assert {r["prediction"] for r in out_of_fold(single, term_stages(4), folds).where("fold = 0").collect()} <= {0.0, 1.0}
    parted.unpersist()


@pytest.mark.parametrize("whole_words", [False, True])
def test_nested_terms_of_long_lists(spark, whole_words):
    """By the row and by the join: the same terms in the same order."""
    words = ["jam tangan", "jam", "xjam", "tangan pria", "tangan", "pria jam", "b"]
    rows = spark.createDataFrame([(1, words), (2, words[::-1]), (3, []), (4, None), (5, ["a"])], "id long, terms array<string>")
    for long in (0, 3, 100):
        got = {r["id"]: r["out"] for r in minimal_lists(rows, "id", "terms", "out", whole_words, long).collect()}
        want = {1: ["jam", "tangan", "b"], 2: ["b", "tangan", "jam"], 3: [], 5: ["a"]}
        if whole_words:
            want[1].insert(1, "xjam")
            want[2].insert(2, "xjam")
        assert {i: t for i, t in got.items() if i != 4} == want


def test_a_title_with_thousands_of_terms(spark):
    names = [f"w{i:05d}" for i in range(2500)]
    terms = spark.createDataFrame([(w,) for w in names] + [("w00001 w00002",)], "term string")
    titles = spark.createDataFrame([(1, " ".join(names)), (2, "w00007 x")], "id long, product_name string")
    brands = spark.createDataFrame([], "term string, brand string")
    got = {r["id"]: r["core_terms"] for r in predict(titles, "id", None, terms, brands).collect()}
    assert got == {1: names, 2: ["w00007"]}


def test_jobs_with_a_vocabulary_table(spark, tmp_path):
    """Trained with vectors from a table, written, and predicted from files; no token is in the model itself."""
    labelled = [(f"red jam tangan {i} casio", "jam tangan, jam", "casio", "red") for i in range(20)] + [(f"blue shirt {i} gap", "shirt", "gap", None) for i in range(20)]
    spark.createDataFrame(labelled, LABELLED).write.option("header", True).csv(str(tmp_path / "train"))
    spark.createDataFrame([("jam tangan casio",), ("shirt gap red",), ("jam tangan casio",)], "product_name string").write.option("header", True).csv(str(tmp_path / "new"))
    model = str(tmp_path / "model")
    trained = train_job(spark, str(tmp_path / "train/*.csv"), model, str(tmp_path / "b"), str(tmp_path / "t"), folds=2, num_trees=4, vectors="table")
    assert trained.term_model.vocabulary.where("token = 'shirt'").count() == 1 and [type(s).__name__ for s in trained.term_model.model.stages] == ["RandomForestClassificationModel"]
    predict_job(spark, str(tmp_path / "new/*.csv"), model, str(tmp_path / "b"), str(tmp_path / "t"), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r["product_name"], r["core_terms"], r["brands"]) for r in rows) == [("jam tangan casio", "jam", "casio")] * 2 + [("shirt gap red", "shirt", "gap")]
    with pytest.raises(ValueError):
        term_stages(vectors="table", vocab_size=10)

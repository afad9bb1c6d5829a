from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from titlekit import session as session_module
from titlekit.plans.predict import predict, predict_job, predict_titles
from titlekit.plans.train import train, train_job
from titlekit.session import materialise, partitioned, shared_folder
from titlekit.sources.attributes import read_brands, read_model, read_terms
from titlekit.sources.titles import read_columns, read_labelled, read_unlabelled
from titlekit.streaming.predict import RowPrinter, predict_stream, read_stream

KINDS = {"tas": ["kulit", "pria", "ransel"], "kamera": ["digital", "mini", "aksi"], "jam tangan": ["sport", "emas", "kayu"]}
BRANDS = {"tas": "Acme", "kamera": "Zeta", "jam tangan": "Big Ben"}


def labelled_rows():
    rows = []
    for term, words in KINDS.items():
        for i in range(12):
            rows.append((f"{BRANDS[term]} {term} {words[i % 3]} baru", term, BRANDS[term] if i % 2 else None, "baru" if i % 4 else None))
    return rows


LABELLED = "product_name string, core_terms string, brand string, stop_words string"


@pytest.fixture(scope="module")
def trained(spark):
    return train(spark.createDataFrame(labelled_rows(), LABELLED), folds=2, num_trees=8)


def test_training(trained):
    assert trained.term_model.labels == [r["term"] for r in trained.terms.orderBy("label_index").collect()]
    assert {(r["term"], r["brand"]) for r in trained.brands.collect()} == {(t, b.lower()) for t, b in BRANDS.items()}
    assert 0.5 < trained.term_model.metric <= 1.0


def test_rare_terms_are_left_to_the_lookup(spark):
    rows = labelled_rows() + [("Lampu meja", "lampu", "Neon", None)]
    fitted = train(spark.createDataFrame(rows, LABELLED), folds=2, num_trees=2, min_term_count=3)
    assert "lampu" not in fitted.term_model.labels and fitted.terms.where("term = 'lampu'").count() == 1
    found = predict_titles(spark.createDataFrame([("Neon lampu belajar",)], "product_name string"), fitted.term_model.model, fitted.terms, fitted.brands)
    assert found.first()["core_terms"] == ["lampu"]


def test_folds_keep_copies_of_a_title_together(spark):
    rows = spark.createDataFrame(labelled_rows(), LABELLED)
    fold = F.pmod(F.xxhash64("product_name"), F.lit(2))
    assert rows.groupBy("product_name").agg(F.countDistinct(fold).alias("n")).where("n > 1").count() == 0


def test_prediction(spark, trained):
    titles = spark.createDataFrame(
        [(1, "ACME Tas Kulit!"), (2, "Jam Tangan & kamera Zeta"), (3, "Sepatu Lari"), (4, None), (5, "")], "id int, product_name string"
    )
    lexicon = spark.createDataFrame([("sepatu", "NNP"), ("tas", "NNP"), ("kulit", "NN")], "word string, tag string")
    model = trained.term_model.model
    plain = {r["id"]: (r["core_terms"], r["brands"]) for r in predict(titles, "id", None, trained.terms, trained.brands).collect()}
    assert plain == {1: (["tas"], ["acme"]), 2: (["kamera", "jam tangan"], ["zeta"]), 3: ([], []), 4: ([], []), 5: ([], [])}
    found = {r["id"]: (r["core_terms"], r["brands"]) for r in predict(titles, "id", model, trained.terms, trained.brands, lexicon).collect()}
    assert found[1] == (["tas"], ["acme"])
    assert found[3] == (["sepatu lari"], []) and found[4] == ([], [])


def test_copies_of_titles_are_all_kept(spark, trained, monkeypatch):
    from titlekit.plans import predict as plan

    monkeypatch.setattr(plan, "REPEAT_ROWS", 7)
    titles = spark.createDataFrame([("Acme tas",)] * 50 + [("Zeta kamera",)] + [(None,)] * 9, "product_name string")
    found = predict_titles(titles, None, trained.terms, trained.brands).collect()
    counted = {}
    for r in found:
        key = (r["product_name"], tuple(r["core_terms"]), tuple(r["brands"]))
        counted[key] = counted.get(key, 0) + 1
    assert counted == {("Acme tas", ("tas",), ("acme",)): 50, ("Zeta kamera", ("kamera",), ("zeta",)): 1, (None, (), ()): 9}


def test_jobs_from_files_to_files(spark, tmp_path):
    lines = ["itemid,stop_words,product_name,core_terms,brand"]
    lines += [f'{i},{s or ""},"{p}","{c}, ",{b or ""}' for i, (p, c, b, s) in enumerate(labelled_rows())]
    for part in range(2):
        (tmp_path / f"train{part}.csv").write_text("\n".join([lines[0], *lines[1 + part :: 2]]) + "\n")
    paths = {name: str(tmp_path / name) for name in ("model", "brands", "terms", "out")}
    train_job(spark, str(tmp_path / "train*.csv"), paths["model"], paths["brands"], paths["terms"], folds=2, num_trees=4)
    asked = ["product_name", '"Tas kulit, Acme"', '"Kamera 5"" Zeta"', "Sepatu", "Sepatu"]
    (tmp_path / "new.csv").write_bytes("\r".join(asked).encode() + b"\r")
    predict_job(spark, str(tmp_path / "new.csv"), paths["model"], paths["brands"], paths["terms"], paths["out"])
    found = spark.read.option("header", True).csv(paths["out"])
    assert found.columns == ["product_name", "core_terms", "brands"]
    rows = sorted((r["product_name"], r["core_terms"], r["brands"]) for r in found.na.fill("").collect())
    assert len(rows) == 4 and rows[-1] == ("Tas kulit, Acme", "tas", "acme")
    assert rows[0][1:] == ("kamera", "zeta") and rows[1] == rows[2] == ("Sepatu", "", "")
    assert read_model(paths["model"]).stages and read_brands(spark, paths["brands"]).count() == 3
    assert read_terms(spark, paths["terms"]).columns == ["label_index", "term"]


def test_columns_are_found_by_name_and_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("brand,product_name,core_terms,stop_words\n007,x,,\n")
    row = read_labelled(spark, str(tmp_path / "a.csv")).first()
    assert (row["product_name"], row["brand"], row["core_terms"]) == ("x", "007", None)
    with pytest.raises(ValueError):
        read_columns(spark, str(tmp_path / "a.csv"), ("missing",))


def test_quotes_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text('product_name;n\n"a; \\"b\\"";1\n')
    assert read_unlabelled(spark, str(tmp_path / "a.csv"), delimiter=";").first()[0] == 'a; "b"'
    (tmp_path / "b.csv").write_text('product_name\n"a ""b"""\n')
    assert read_unlabelled(spark, str(tmp_path / "b.csv"), escape='"').first()[0] == 'a "b"'


def test_paths_are_uris(spark, tmp_path):
    (tmp_path / "a.csv").write_text("product_name\nx\n")
    assert read_unlabelled(spark, f"file://{tmp_path}/*.csv").first()[0] == "x"


def test_terms_in_one_row(spark, tmp_path):
    spark.createDataFrame([("labels", ["b", "a"])], "attr_term string, value array<string>").write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in read_terms(spark, str(tmp_path / "t")).orderBy("label_index").collect()] == [(0, "b"), (1, "a")]


def test_stream_gives_the_batch_result(spark, trained, tmp_path):
    titles = spark.createDataFrame([(i, f"{BRANDS[t]} {t} {i}") for i, t in enumerate(list(KINDS) * 5)], "id int, product_name string")
    titles.repartition(5).write.parquet(str(tmp_path / "in"))
    model = trained.term_model.model
    stream = read_stream(spark, str(tmp_path / "in"), titles.schema, files_per_batch=2)
    for _ in range(2):
        query = predict_stream(stream, "id", model, trained.terms, trained.brands, str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).drop("batch", "run")
    batch = predict(titles, "id", model, trained.terms, trained.brands)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect())) and found.count() == 15


def test_row_printer():
    seen = []
    printer = RowPrinter(seen.append)
    assert printer.open(0, 0) is True
    printer.process("row")
    printer.close(None)
    assert seen == ["row"]


def test_shared_folder_is_the_one_the_cluster_names(spark, monkeypatch):
    folder = shared_folder(spark)
    assert shared_folder(spark) == folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session_module.shared_folder(Session())


def test_partitioned_rows_are_grouped_without_a_shuffle(spark):
    kept = partitioned(spark.range(100).withColumn("x", F.col("id") % 7), "id")
    plan = kept.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan
    kept.unpersist()
    assert materialise(spark.range(3)).count() == 3

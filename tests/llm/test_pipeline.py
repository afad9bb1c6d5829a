from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from titlekit.llm import decontaminate, rules, secrets, simhash

FOLDER = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "tokens"]
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = source
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.dtypes == source.dtypes
        old, new = ({r["doc_id"]: r.asDict() for r in t.collect()} for t in (before, docs))
        if name == "quality_rules":
            assert set(new) == {r["doc_id"] for r in rules.verdicts(before).where("kept").collect()}
        elif name == "near_duplicates":
            assert set(new) == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert all(new[k] == old[k] for k in new)
        elif name == "decontamination":
            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert set(new) == {r["doc_id"] for r in decontaminate.contamination(before, items).where("NOT contaminated").collect()}
            assert all(new[k] == old[k] for k in new)
        elif name == "secret_scan":
            found = {r["doc_id"] for r in secrets.report(before).where("spans <> ''").collect()}
            assert set(new) == set(old) and {k for k in new if new[k] != old[k]} == found
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert set(new) == set(old)
            assert all(r["ids"] == library.encode(old[k]["text"], add_special_tokens=False).ids for k, r in new.items())


def test_odd_rows_pass_through(spark, odd, nothing, tmp_path):
    for k, docs in enumerate((odd, nothing)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, FOLDER)
            assert name == "tokens" or found.columns == odd.columns
            found.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.count() <= n


def test_run_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, FOLDER).count() > 0

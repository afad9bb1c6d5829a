"""The text queries against their SQL, and their contracts."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from titlekit.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3": {"doc_id": "bigint", "text": "string"},
    "op4": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op7": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12": {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"},
    "op13": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


def test_all():
    assert {name.split("_")[0] for name in QUERIES} == set(COLUMNS)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    said = compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name])
    assert said.startswith("ok"), said


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, folder, name):
    out = QUERIES[name](spark, folder)
    want = COLUMNS[name.split("_")[0]]
    assert {n: t for n, t in out.dtypes if n in want} == want
    if not {"doc_id", "page_id"} & set(want):
        assert out.count() > 0
        return
    table = "pages" if "page_id" in want else "documents"
    assert out.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()

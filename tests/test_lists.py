from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from titlekit.functions.lists import (
    explode_keeping_null,
    list_text,
    minimal_terms,
    parse_list,
    priority_merge,
    shared_items,
    text_list,
    without_words,
)
from titlekit.operators.containment import minimal_in_order, minimal_terms_of, shortest_runs
from titlekit.queries import text


def test_parse_list(spark):
    rows = spark.createDataFrame([(" Tas,\tTAS kulit ,,",), (None,), (",",)], "c string")
    assert [r[0] for r in rows.select(parse_list("c")).collect()] == [["tas", "tas kulit"], [], []]
    assert [len(r[0]) for r in rows.select(parse_list("c", keep_empty=True)).collect()] == [4, 1, 2]


def test_explode_keeps_null_lists_and_drops_empty_ones(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "id int, c array<string>")
    found = rows.select("id", explode_keeping_null("c").alias("x")).collect()
    assert [(r["id"], r["x"]) for r in found] == [(1, "a"), (1, "b"), (2, None)]


def test_without_words_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c"], ["a"]), (["a"], None)], "t array<string>, w array<string>")
    assert [r[0] for r in rows.select(without_words("t", "w")).collect()] == [["b", "b", "c"], ["a"]]


def test_shared_items(spark):
    rows = spark.createDataFrame([(["b", "a", "b"], ["a", "b", "z"])], "t array<string>, w array<string>")
    assert rows.select(shared_items("t", "w")).first()[0] == ["b", "a"]


def test_minimal_terms_keeps_the_shortest(spark):
    rows = spark.createDataFrame([(["jam", "jam tangan", "jam tangan pria"],), (["case", "suitcase"],), ([],)], "c array<string>")
    assert [r[0] for r in rows.select(minimal_terms("c")).collect()] == [["jam"], ["case"], []]
    assert rows.select(minimal_terms("c", whole_words=True)).collect()[1][0] == ["case", "suitcase"]


def test_priority_merge(spark):
    rows = spark.createDataFrame(
        [(["jam"], ["jam pria", "tas"]), ([], ["a", "a b"]), (["a"], [])], "a array<string>, b array<string>"
    )
    assert [r[0] for r in rows.select(priority_merge("a", "b")).collect()] == [["jam", "tas"], ["a", "a b"], ["a"]]


def test_list_text(spark):
    rows = spark.createDataFrame([(["a", "b c"],), ([],)], "c array<string>").select("c", list_text("c").alias("t"))
    assert [r["t"] for r in rows.collect()] == ["a, b c", ""]
    assert [r[0] for r in rows.select(text_list("t")).collect()] == [["a", "b c"], []]


WORDS = st.lists(st.text(alphabet="ab ", min_size=1, max_size=4).map(str.strip).filter(bool), max_size=6, unique=True)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lists=st.lists(WORDS, min_size=1, max_size=6), whole=st.booleans())
def test_both_forms_of_minimal_terms_agree_and_leave_no_nested_term(spark, lists, whole):
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, c array<string>")
    kept = {r["id"]: sorted(r["k"]) for r in rows.select("id", minimal_terms("c", whole).alias("k")).collect()}
    hits = rows.select("id", F.explode("c").alias("term"))
    joined = {i: [] for i in kept}
    for r in minimal_terms_of(hits, "id", whole_words=whole).collect():
        joined[r["id"]].append(r["term"])
    assert kept == {i: sorted(terms) for i, terms in joined.items()}
    if not whole:
        assert not any(x != y and y in x for terms in kept.values() for x in terms for y in terms)


def test_minimal_lists_in_order_are_the_same_by_search_and_by_join(spark):
    lists = {1: ["suitcase", "pan", "case", "red pan"], 2: ["red pan", "suitcase"], 3: ["pan"], 4: ["case", "case"], None: ["pan", "red pan"]}
    rows = [(i, at, t) for i, items in lists.items() for at, t in enumerate(items)]
    hits = spark.createDataFrame(rows, "id int, pos int, term string")
    terms = hits.select("term")
    wanted = {1: ["pan", "case"], 2: ["red pan", "suitcase"], 3: ["pan"], 4: ["case", "case"], None: ["pan", "red pan"]}
    for long in (None, 3, 0):
        assert {r["id"]: r["out"] for r in minimal_in_order(hits, "id", "out", terms, long=long).collect()} == wanted
    whole = minimal_in_order(hits, "id", "out", terms, whole_words=True).collect()
    assert {r["id"]: r["out"] for r in whole}[1] == ["suitcase", "pan", "case"]
    assert sorted(r["term"] for r in shortest_runs(terms.distinct()).collect()) == ["case", "pan", "suitcase"]


def test_minimal_terms_of_documents_look_only_for_terms_that_can_be_minimal(spark, tmp_path, monkeypatch):
    items = [("a", "the red suitcase"), ("b", "case"), ("c", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "Red suitcase and a case, the red suitcase"), (2, "red suitcase"), (3, "nothing"), (4, None), (None, "the red case"), (2, "case")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    looked_for, hits = [], text.term_hits

    def seen(titles, id_col, tokens_col, terms):
        looked_for.append({r["term"] for r in terms.collect()})
        return hits(titles, id_col, tokens_col, terms)

    monkeypatch.setattr(text, "term_hits", seen)
    found = {r["doc_id"]: r["terms"] for r in text.minimal_document_terms(spark, str(tmp_path)).collect()}
    assert looked_for[0] == {"the", "red", "suitcase", "case"}
    # a document without an id is not compared with itself
    assert found.pop(2) in ("case|red", "red|case")
    assert found == {1: "red|case|the", None: "the|red|case|the red"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(first=WORDS, second=WORDS)
def test_priority_merge_keeps_the_first_list(spark, first, second):
    rows = spark.createDataFrame([(first, second)], "a array<string>, b array<string>")
    merged = rows.select(priority_merge("a", "b")).first()[0]
    assert merged[: len(first)] == first
    assert all(not any(x in t for x in first) for t in merged[len(first):])


@pytest.mark.parametrize("small", [True, False])
def test_lookup_join_gives_the_same_rows_by_broadcast_and_by_salting(spark, small):
    from titlekit.operators.lookup import lookup_join

    big = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(300)], "id int, word string")
    dim = spark.createDataFrame([("hot", 1), ("w3", 2), ("unused", 3)], "word string, n int")
    joined = {how: lookup_join(big, dim, ["word"], how, small=small) for how in ("inner", "left", "left_semi", "left_anti")}
    assert {h: df.count() for h, df in joined.items()} == {"inner": 201, "left": 300, "left_semi": 201, "left_anti": 99}
    assert joined["left"].where("id = 3").first()["n"] == 2


def test_lookup_tables_are_measured(spark):
    from titlekit.operators.lookup import fits_broadcast

    dim = spark.range(100).withColumn("word", F.lit("x" * 100))
    assert fits_broadcast(dim)
    assert not fits_broadcast(dim, max_rows=99)
    assert not fits_broadcast(dim, max_bytes=5000)

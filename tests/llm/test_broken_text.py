"""Texts that are not UTF-8, and classes without number: nothing ends a job."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from titlekit.llm import bpe, common, decontaminate, entities, extract, langid, pii, quality, rules, secrets, sharding, simhash, spelling, toxicity
from titlekit.llm.queries import PII_KEY, tokenizer_file

BROKEN = "cast(unhex('ff416200') AS string)"


@pytest.fixture(scope="module")
def broken(spark):
    """Documents with bytes that are not UTF-8, a line that many of them share, and a name to replace."""
    odd = "decode_as(unhex('46696e65206c696e6520c328'))".replace("decode_as", "string")
    rows = spark.range(40).selectExpr(
        "id AS doc_id",
        f"CASE WHEN id = 0 THEN {BROKEN} WHEN id = 1 THEN concat('Mail a.b@c.org now ', {BROKEN}) "
        f"ELSE concat({odd}, '\\none two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen number ', translate(id * 7919, '0123456789', 'abcdefghij'), ' sixteen seventeen', "
        f"' eighteen nineteen twenty of page ', translate(id * 104729, '0123456789', 'abcdefghij'), ' with words of its own') END AS text",
        "'en' AS lang", "'host' AS source", "5L AS n_chars")
    return rows


@pytest.fixture(scope="module")
def labels(broken):
    return broken.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


def test_every_operator_lives(spark, broken, labels):
    assert quality.scored(broken, labels).count() == 40
    assert toxicity.scored(broken, labels).count() == 40
    assert simhash.near_duplicates(broken).count() == 40
    assert {r["lang_pred"] for r in langid.predicted(broken).collect()} == {"en"}
    assert decontaminate.contamination(broken, broken.select(F.col("doc_id").alias("item_id"), "text")).count() == 40
    assert secrets.report(broken).count() == 40
    assert sharding.assigned(broken, 3).count() == 40
    assert spelling.variants(spelling.word_counts(broken)).where("word = 'thirteen'").first()["n"] == 38
    pages = broken.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert all("�" in r["text"] for r in extract.extracted(pages).collect())


def test_surrogates(broken):
    got = {r["doc_id"]: r for r in pii.surrogated(broken, PII_KEY).collect()}
    assert len(got) == 40 and "a.b@c.org" not in got[1]["text"] and got[1]["kinds"] == "email:1"
    assert got[1]["text"].endswith("�Ab\x00") and got[0]["text"] == "�Ab\x00"


def test_tokens(broken):
    """Such a byte is encoded as the replacement character."""
    got = {r["doc_id"]: r for r in bpe.round_trip(broken, tokenizer_file()).collect()}
    assert got[0]["decoded_sha256"] == hashlib.sha256("�Ab\x00".encode()).hexdigest()


def test_lines_and_pipeline_stages(spark, broken, folder):
    """The shared line leaves the texts although it is not UTF-8."""
    kept = {r["doc_id"]: r["text"] for r in rules.accepted(broken).collect()}
    assert len(kept) == 38 and not any("Fine line" in t for t in kept.values())
    docs = broken
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 38


def test_numeric_signs_are_no_letters(spark, broken):
    asked = spark.createDataFrame([(1, "² ½ ③ Ⅷ"), (2, "ª"), (3, "漢"), (4, "12 _")], "doc_id bigint, text string").select("*", F.lit(None).cast("string").alias("lang"))
    both = broken.select("doc_id", "text", "lang").where("doc_id > 4").unionByName(asked)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(both).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("und", "en", "en", "und")


def test_a_thousand_classes_in_one_pass(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "concat('l', id % 1000) AS lang")
    sample = common.labelled_sample(rows, rows, "lang", "doc_id", "text", 2, 1 << 20)
    assert len({y for _, y, _ in sample}) >= 990 and max(sum(y == z for _, z, _ in sample) for y in ("l1", "l2", "l3")) <= 2
    # the same rows as the two of lowest hash of each class
    learned = rows.where(common.learnable("doc_id"))
    want = {(r["text"].encode(), r["lang"]) for r in learned.selectExpr("text", "lang", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id), doc_id) AS n").where("n <= 2").collect()}
    assert {(t, y) for t, y, _ in sample} == want


def test_a_full_kind_ends(spark):
    """More telephone numbers of two digits than there are surrogates of two digits."""
    numbers = spark.range(90).selectExpr("'phone:2' AS kind", "cast(id + 10 AS string) AS canonical")
    got = pii.assigned(numbers, b"key").collect()
    assert len(got) == 90 == len({r["surrogate"] for r in got}) and not {r["surrogate"] for r in got} & {r["canonical"] for r in got}
    assert entities.written("1234", "1-2", "phone:2") == "1-234" and entities.written("12", "+49 1 2", "phone:2") == "+49 1 2"

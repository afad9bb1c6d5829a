from __future__ import annotations

from pyspark.ml.feature import NGram, RegexTokenizer
from pyspark.sql import functions as F

from titlekit.functions.text import clean_text, ngrams, short_phrases, title_tokens, with_ngrams


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression.alias("r")).first()["r"]


def test_tokens_are_lower_case_words_of_some_length(spark):
    text = "Kamera-X 4K a_b é Éclair (NEW)"
    assert one(spark, text, title_tokens(F.col("c"), 2)) == ["kamera", "4k", "a_b", "clair", "new"]
    assert one(spark, text, title_tokens(F.col("c"), 3)) == ["kamera", "a_b", "clair", "new"]
    assert one(spark, text, title_tokens(F.col("c"), 3, unicode=True)) == ["kamera", "a_b", "éclair", "new"]


def test_no_text_has_no_tokens(spark):
    assert one(spark, None, title_tokens(F.col("c"))) == []
    assert one(spark, "", title_tokens(F.col("c"))) == []
    assert one(spark, "", with_ngrams(title_tokens(F.col("c")))) == []


def test_tokens_and_ngrams_agree_with_spark_ml(spark):
    rows = spark.createDataFrame([("Tas kulit pria XL a 12 mm",), ("satu",), ("",)], "title string")
    tokenizer = RegexTokenizer(inputCol="title", outputCol="ml", pattern=r"\w+", gaps=False, minTokenLength=2)
    both = tokenizer.transform(rows).withColumn("ours", title_tokens("title", 2))
    for n in (2, 3):
        both = NGram(n=n, inputCol="ml", outputCol=f"ml{n}").transform(both).withColumn(f"ours{n}", ngrams("ours", n))
    for row in both.collect():
        assert row["ml"] == row["ours"] and row["ml2"] == row["ours2"] and row["ml3"] == row["ours3"]


def test_ngrams_follow_tokens(spark):
    assert one(spark, ["a", "b", "c"], with_ngrams("c"), "array<string>") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, ["a"], with_ngrams("c"), "array<string>") == ["a"]


def test_cleaning(spark):
    assert one(spark, "Acme Go-16MP (2 pcs) x_y|z\\w", clean_text(F.col("c"))).split() == ["Acme", "Go", "pcs", "x_y|z\\w"]


def test_short_phrases(spark):
    phrases = ["Jam Tangan Pria", "A B C D", "X"]
    assert one(spark, phrases, short_phrases("c"), "array<string>") == ["jam tangan pria", "x"]

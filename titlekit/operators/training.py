"""Labelled titles to feature rows; stop words (PRJ1-PRJ3, ARR2-ARR5, AGG2, TXT5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.functions.lists import explode_keeping_null, parse_list, without_words
from titlekit.functions.text import TRAIN_MIN_LEN, title_tokens
from titlekit.operators.lookup import lookup_join


def normalised_rows(labelled: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``title, stop_words, targets, brands`` from the four text columns; null brand and stop words are empty lists."""
    filled = labelled.na.fill("", ["brand", "stop_words"])
    return filled.select(
        *keep,
        F.col("product_name").alias("title"),
        parse_list("stop_words", keep_empty=True).alias("stop_words"),
        parse_list("core_terms").alias("targets"),
        parse_list("brand").alias("brands"),
    )


def training_features(labelled: DataFrame, min_len: int = TRAIN_MIN_LEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row ``tokens, target, brands, stop_words`` per title and target; a row's own stop words are removed.

    ``keep`` names further columns of ``labelled`` to carry, or ``title``.
    """
    rows = normalised_rows(labelled, tuple(c for c in keep if c != "title"))
    tokens = without_words(title_tokens(F.col("title"), min_len), "stop_words")
    return rows.select(
        *keep, tokens.alias("tokens"), explode_keeping_null("targets").alias("target"), "brands", "stop_words"
    )


def corpus_stop_words(features: DataFrame, col: str = "stop_words") -> DataFrame:
    """Distinct stop words ``(word)`` over all rows."""
    return features.select(F.explode(col).alias("word")).where(F.col("word") != "").distinct()


def without_corpus_words(titles: DataFrame, id_col: str, tokens_col: str, words: DataFrame, out: str) -> DataFrame:
    """Tokens that are not among ``words`` in any case, order and repeats kept, by an anti-join (TXT5)."""
    tokens = titles.select(id_col, F.posexplode(tokens_col).alias("pos", "token")).withColumn("word", F.lower("token"))
    lowered = words.select(F.lower("word").alias("word")).distinct()
    kept = lookup_join(tokens, lowered, ["word"], "left_anti")
    placed = F.array_sort(F.collect_list(F.struct("pos", "token")))
    lists = kept.groupBy(id_col).agg(F.transform(placed, lambda t: t["token"]).alias(out))
    # as many lists as rows, whatever the planner's estimate says
    joined = titles.join(lists.hint("merge"), id_col, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))

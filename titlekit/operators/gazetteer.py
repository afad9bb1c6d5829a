"""Find known terms in token lists (JOIN2, ARR7, ARR8, ML11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.operators.lookup import lookup_join
from titlekit.operators.membership import maybe_among


def term_hits(titles: DataFrame, id_col: str, tokens_col: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``(id, pos, term)``: each known term of a title once, in the order of first sight by ``pos``.

    Where the terms fit a broadcast, a filter inside the list lets few other tokens become rows (``maybe_among``); the join
    then settles which of them are terms.
    """
    known = terms.select(F.col(term_col).alias("term")).where("term is not null").distinct()
    small, maybe = maybe_among(known.withColumnRenamed("term", "word"))
    tokens = F.filter(tokens_col, maybe) if maybe else F.col(tokens_col)
    grams = titles.select(id_col, F.posexplode(F.array_distinct(tokens)).alias("pos", "term"))
    return lookup_join(grams, known, ["term"], small=small).select(id_col, "pos", "term")


def in_order(hits: DataFrame, id_col: str, out: str) -> DataFrame:
    """``(id, out)``: the hits of a title as one list, in order of place."""
    placed = F.array_sort(F.collect_list(F.struct("pos", "term")))
    return hits.groupBy(id_col).agg(F.transform(placed, lambda h: h["term"]).alias(out))


def known_terms(titles: DataFrame, id_col: str, tokens_col: str, terms: DataFrame, term_col: str = "term",
                out: str = "terms") -> DataFrame:
    """Add the list ``out`` of known terms in each title's tokens, first seen first; no title is lost."""
    lists = in_order(term_hits(titles, id_col, tokens_col, terms, term_col), id_col, out)
    # as many lists as rows, whatever the planner's estimate says
    joined = titles.join(lists.hint("merge"), id_col, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def checked_prediction(predicted, tokens, gazetteer) -> Column:
    """The predicted term if the title has it, otherwise the known terms found in the title (ML11)."""
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.when(F.array_contains(tokens, predicted), F.array(predicted)).otherwise(F.col(gazetteer))

"""Term to brand tables and the brand lookup (FLT1, ARR4, AGG1, AGG3, ARR12, JOIN3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.functions.lists import explode_keeping_null
from titlekit.operators.lookup import lookup_join


def brand_pairs(features: DataFrame, target_col: str = "target", brands_col: str = "brands") -> DataFrame:
    """Distinct ``(term, brand)`` pairs of the training rows that name a brand."""
    branded = features.where(F.size(brands_col) > 0)
    return branded.select(F.col(target_col).alias("term"), explode_keeping_null(brands_col).alias("brand")).distinct()


def brands_present(titles: DataFrame, id_col: str, tokens_col: str, pairs: DataFrame) -> DataFrame:
    """``(id, present)``: the known brands among each title's tokens; titles without one are left out."""
    words = titles.select(id_col, F.explode(F.array_distinct(tokens_col)).alias("brand"))
    present = lookup_join(words, pairs.select("brand").distinct(), ["brand"])
    return present.groupBy(id_col).agg(F.collect_list("brand").alias("present"))


def title_brands(titles: DataFrame, id_col: str, terms_col: str, present: DataFrame, pairs: DataFrame,
                 out: str = "brands") -> DataFrame:
    """Add the brands that belong to one of the title's terms and are ``present`` in the title.

    Only combinations of the terms and brands inside one title are formed, then kept if they are known pairs; a term
    with very many brands never multiplies the titles that carry it. Each brand is listed once, by place of its first
    term, then by name. Rows by title are joined and grouped by ``id`` only, so titles that are already partitioned by
    it are not shuffled.
    """
    known = pairs.select("term", "brand").distinct().withColumn("_known", F.lit(True))
    carried = [c for c in titles.columns if c != id_col]
    candidates = (
        titles.join(present, id_col, "left")
        .select("*", F.posexplode_outer(terms_col).alias("pos", "term"))
        .select(id_col, *carried, "pos", "term", F.explode_outer("present").alias("brand"))
    )
    checked = lookup_join(candidates, known, ["term", "brand"], "left")
    kept = F.when(F.col("_known"), F.struct("pos", "brand"))
    grouped = checked.groupBy(id_col).agg(*[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(kept)).alias("_kept"))
    return grouped.select(id_col, *carried, F.array_distinct(F.transform("_kept", lambda k: k["brand"])).alias(out))

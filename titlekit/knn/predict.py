"""Votes and means over neighbours (KNN10, KNN11, AGG8-AGG12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_histogram(train: DataFrame, label_col: str = "label") -> DataFrame:
    """``label, n`` (AGG8)."""
    return train.groupBy(F.col(label_col).cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_count(train: DataFrame, label_col: str = "label") -> int:
    """One more than the greatest label; labels must be whole numbers from 0 on."""
    label = F.col("label")
    bad = F.sum(F.when(label.isNull() | F.isnan(label) | (label < 0) | (label != F.floor(label)), F.col("n")).otherwise(0))
    top, invalid = class_histogram(train, label_col).agg(F.max("label"), bad).first()
    if invalid:
        raise ValueError(f"labels must be 0, 1, 2, ...; found {invalid} rows with other labels")
    return int(top) + 1 if top is not None else 0


def votes(neighbours: DataFrame, label_col: str = "label", weight_col: str | None = None) -> DataFrame:
    """``qid, label, votes, probability``: weight of each class among a query's neighbours (AGG9, AGG10)."""
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    by_class = neighbours.groupBy("qid", F.col(label_col).cast("double").alias("label")).agg(F.sum(weight).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("qid"))
    return by_class.withColumn("probability", F.when(total != 0, F.col("votes") / total))


def winners(voted: DataFrame) -> DataFrame:
    """``qid, prediction``: the class with the most votes, the smallest label on a tie (AGG11)."""
    best = F.max(F.struct("votes", (-F.col("label")).alias("order")))
    chosen = voted.groupBy("qid").agg(best.alias("best"), F.sum("votes").alias("total"))
    return chosen.select("qid", F.when(F.col("total") != 0, -F.col("best.order")).alias("prediction"))


def classified(queries: DataFrame, neighbours: DataFrame, classes: int, id_col: str = "qid", label_col: str = "label",
               weight_col: str | None = None) -> DataFrame:
    """Add ``raw``, ``probability`` and ``prediction``; null where a query has no neighbour or no weight (KNN10)."""
    voted = votes(neighbours, label_col, weight_col)
    best = F.max(F.struct("votes", (-F.col("label")).alias("order")))
    shares = F.map_from_entries(F.collect_list(F.struct("label", "votes")))
    by_query = voted.groupBy("qid").agg(shares.alias("_votes"), best.alias("_best"), F.sum("votes").alias("_total"))
    every_class = F.sequence(F.lit(0), F.lit(classes - 1))
    raw = F.transform(every_class, lambda c: F.coalesce(F.element_at("_votes", c.cast("double")), F.lit(0.0)))
    out = by_query.select(F.col("qid").alias(id_col), raw.alias("raw"), "_total", (-F.col("_best.order")).alias("_label")).select(
        id_col, "raw",
        F.when(F.col("_total") != 0, F.transform("raw", lambda v: v / F.col("_total"))).alias("probability"),
        F.when(F.col("_total") != 0, F.col("_label")).alias("prediction"),
    )
    return queries.join(out, id_col, "left")


def regressed(queries: DataFrame, neighbours: DataFrame, id_col: str = "qid", label_col: str = "label",
              weight_col: str | None = None) -> DataFrame:
    """Add ``prediction``, the weighted mean label of the neighbours, null without neighbour or weight (KNN11, AGG12)."""
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    sums = neighbours.groupBy(F.col("qid").alias(id_col)).agg(
        F.sum(F.col(label_col).cast("double") * weight).alias("_sum"), F.sum(weight).alias("_weight")
    )
    means = sums.select(id_col, F.when(F.col("_weight") != 0, F.col("_sum") / F.col("_weight")).alias("prediction"))
    return queries.join(means, id_col, "left")

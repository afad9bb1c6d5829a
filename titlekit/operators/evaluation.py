"""Classification metrics over (label, prediction) rows (AGG17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_metrics(scored: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """``label, support, precision, recall, f1`` for each class that occurs as a label."""
    cells = scored.groupBy(F.col(label_col).alias("l"), F.col(prediction_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("l").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    ).where(F.col("support") > 0)
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    scores = totals.select("label", "support", "hits", precision.alias("precision"), (F.col("hits") / F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return scores.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def weighted_metrics(scored: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """One row ``f1, weightedPrecision, weightedRecall, accuracy``, classes weighted by their share of the labels."""
    by_class = class_metrics(scored, label_col, prediction_col)
    rows = F.sum("support")
    return by_class.agg(
        (F.sum(F.col("f1") * F.col("support")) / rows).alias("f1"),
        (F.sum(F.col("precision") * F.col("support")) / rows).alias("weightedPrecision"),
        (F.sum(F.col("recall") * F.col("support")) / rows).alias("weightedRecall"),
        (F.sum("hits") / rows).alias("accuracy"),
    )

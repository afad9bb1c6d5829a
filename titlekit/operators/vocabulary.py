"""Label and token vocabularies (AGG4, AGG5, JOIN1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlekit.operators.lookup import lookup_join
from titlekit.session import materialise


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in the given total order without bringing them into one task.

    Rows are range-partitioned and written down, so the partition of a row is fixed; only the row count of each
    partition goes through the single-task running sum.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # one row per shuffle partition, so the broadcast side is bounded by the session's partition count
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_start") + place - 1).cast("long"))
        .drop("_part", "_start")
    )


def term_vocabulary(features: DataFrame, col: str = "target", min_count: int = 1) -> DataFrame:
    """``label_index, term, freq``: the distinct terms, most frequent first, then by name."""
    counts = features.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("term")).agg(F.count(F.lit(1)).alias("freq"))
    if min_count > 1:
        counts = counts.where(F.col("freq") >= min_count)
    return numbered(counts, [F.col("freq").desc(), F.col("term").asc()], "label_index").select("label_index", "term", "freq")


def token_counts(titles: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``token, freq`` over all rows."""
    return titles.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def index_to_term(scored: DataFrame, vocabulary: DataFrame, prediction_col: str = "prediction",
                  out: str = "predicted_term") -> DataFrame:
    """Add the term of a predicted label index; an unknown index gives null (JOIN1)."""
    names = vocabulary.select(F.col("label_index").cast("double").alias(prediction_col), F.col("term").alias(out))
    return lookup_join(scored, names, [prediction_col], "left")

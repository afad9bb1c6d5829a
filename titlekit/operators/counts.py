"""Count vectors without the driver: the vocabulary is a table, vectors come from a grouping (ML2, ML10)."""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlekit.operators.lookup import lookup_join
from titlekit.operators.vocabulary import numbered
from titlekit.session import materialise


def fit_vocabulary(rows: DataFrame, tokens_col: str = "tokens", min_df: int = 1) -> DataFrame:
    """``index, token, freq``: the different tokens, the most frequent first, then by name, written down.

    ``min_df`` leaves out tokens that stand in fewer rows. Tokens are numbered over range partitions, so neither the driver
    nor one task holds them; ``write_table`` keeps the table for prediction.
    """
    tokens = rows.select(F.explode(F.array_compact(tokens_col)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    if min_df > 1:
        held = rows.select(F.explode(F.array_distinct(F.array_compact(tokens_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.join(held.where(F.col("rows") >= min_df).select("token"), "token")
    return materialise(numbered(counts, [F.col("freq").desc(), F.col("token").asc()], "index").select("index", "token", "freq"))


def token_totals(rows: DataFrame, id_col: str, tokens_col: str, vocabulary: DataFrame) -> DataFrame:
    """``id, index, n``: how often each row has each token of the vocabulary; other tokens are left out."""
    counts = rows.select(id_col, F.explode(tokens_col).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    return lookup_join(counts, vocabulary.select("token", "index"), ["token"]).select(id_col, "index", "n")


def count_vectors(rows: DataFrame, id_col: str, tokens_col: str, vocabulary: DataFrame, out: str = "counts") -> DataFrame:
    """``rows`` (unique by ``id``) with ``out``, a sparse vector as a struct of ``indices`` and ``counts``, by index.

    A row holds its own tokens only; a row without a known token has empty lists.
    """
    pairs = F.array_sort(F.collect_list(F.struct("index", "n")))
    lists = token_totals(rows, id_col, tokens_col, vocabulary).groupBy(id_col).agg(pairs.alias("_pairs"))
    # as many lists as rows, whatever the planner's estimate says
    joined = rows.join(lists.hint("merge"), id_col, "left")
    pairs = F.coalesce("_pairs", F.array().cast("array<struct<index:bigint,n:bigint>>"))
    made = F.struct(F.transform(pairs, lambda p: p["index"]).alias("indices"), F.transform(pairs, lambda p: p["n"].cast("double")).alias("counts"))
    return joined.withColumn(out, made).drop("_pairs")


def as_vector(counts: Column | str, size: int) -> Column:
    """The struct of ``count_vectors`` as an ML vector of ``size`` numbers, for the stages of Spark ML.

    Spark has no expression that makes a sparse vector, hence a function over rows; it only packs two lists.
    """
    packed = F.udf(lambda c: None if c is None else SparseVector(size, c["indices"], c["counts"]), VectorUDT())
    return packed(counts)

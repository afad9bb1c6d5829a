"""Brand and term tables, fitted models (SRC3-SRC5, SNK1-SNK3)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("term", "brand")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``label_index, term``; a table of one row with all terms as a list is unfolded."""
    table = spark.read.parquet(path)
    if "value" in table.columns:
        table = table.select(F.posexplode("value").alias("label_index", "term"))
    return table.select(F.col("label_index").cast("long").alias("label_index"), "term")


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def stop_words_path(model_path: str) -> str:
    """Where the corpus stop words of a saved model are: beside it."""
    return f"{str(model_path).rstrip('/')}-stop-words"


def read_stop_words(spark: SparkSession, model_path: str) -> DataFrame | None:
    """``word``: the stop words of a saved model; None if it was saved without."""
    try:
        return spark.read.parquet(stop_words_path(model_path)).select("word")
    except AnalysisException:
        return None


def vocabulary_path(model_path: str) -> str:
    """Where the token vocabulary of a model with ``vectors="table"`` is: beside it."""
    return f"{str(model_path).rstrip('/')}-vocabulary"


def read_vocabulary(spark: SparkSession, model_path: str) -> DataFrame | None:
    """``index, token``: the vocabulary of a saved model; None if its vectors need no table."""
    try:
        table = spark.read.parquet(vocabulary_path(model_path)).select("index", "token")
    except AnalysisException:
        return None
    return None if table.isEmpty() else table


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

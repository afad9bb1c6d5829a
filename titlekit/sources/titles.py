"""Title files as CSV (SRC1, SRC2, SRC6, SNK4). Paths may be any Hadoop URI or glob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlekit.functions.lists import list_text

LABELLED = ("product_name", "core_terms", "brand", "stop_words")
UNLABELLED = ("product_name",)

# Writer options that keep blanks at the ends of a value.
AS_IS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_columns(spark: SparkSession, path, columns: tuple[str, ...], delimiter: str = ",", escape: str = "\\") -> DataFrame:
    """The named columns of CSV files with a header, all as text, wherever they stand in the file.

    Types are not inferred, so a column of numbers stays text. Line ends may be LF, CRLF or a bare CR.
    """
    options = {"header": True, "sep": delimiter, "escape": escape}
    header = spark.read.options(**options).csv(path).columns
    missing = set(columns) - set(header)
    if missing:
        raise ValueError(f"no column {sorted(missing)} in {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # the names are compared in every file, so one with another order of columns fails instead of being misread
    return spark.read.options(**options, enforceSchema=False).schema(schema).csv(path).select(*columns)


def read_labelled(spark: SparkSession, path, **options) -> DataFrame:
    """``product_name, core_terms, brand, stop_words`` of training files (SRC1)."""
    return read_columns(spark, path, LABELLED, **options)


def read_unlabelled(spark: SparkSession, path, **options) -> DataFrame:
    """``product_name`` of prediction files (SRC2)."""
    return read_columns(spark, path, UNLABELLED, **options)


def write_results(predicted: DataFrame, path: str) -> None:
    """``product_name, core_terms, brands`` as CSV with a header, lists joined by ``", "`` (SNK4, PRJ5)."""
    predicted.select(
        "product_name", list_text(F.col("core_terms")).alias("core_terms"), list_text(F.col("brands")).alias("brands")
    ).write.mode("overwrite").options(**AS_IS).csv(path)

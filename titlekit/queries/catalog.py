"""The register of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlekit.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same rows in DuckDB."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts, on all cores."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def labelled_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as labelled titles: two nested core terms each, brands and stop words on some."""
    part = spread(table(spark, folder, "part"))
    noun = F.split("p_name", " ")[1]
    brand = F.regexp_replace("p_brand", "#", "")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", brand, "p_type").alias("product_name"),
        F.concat(F.upper(noun), F.lit(" , "), "p_name").alias("core_terms"),
        F.when(F.col("p_size") % 2 == 1, F.concat(brand, F.lit(", "), noun, F.lit(", "))).alias("brand"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lower("p_type"), F.lit(", Hot"))).alias("stop_words"),
    )


LABELLED_SQL = """
labelled AS (
  SELECT p_partkey AS id,
         p_name || ' ' || replace(p_brand, '#', '') || ' ' || p_type AS product_name,
         upper(split_part(p_name, ' ', 2)) || ' , ' || p_name AS core_terms,
         CASE WHEN p_size % 2 = 1 THEN replace(p_brand, '#', '') || ', ' || split_part(p_name, ' ', 2) || ', ' END AS brand,
         CASE WHEN p_size % 3 = 0 THEN lower(p_type) || ', Hot' END AS stop_words
  FROM part),
parsed AS (
  SELECT id, product_name AS title,
         list_transform(string_split(coalesce(stop_words, ''), ','), lambda x: lower(trim(x))) AS stop_words,
         list_filter(list_transform(string_split(core_terms, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS targets,
         list_filter(list_transform(string_split(coalesce(brand, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '') AS brands
  FROM labelled),
features AS (
  SELECT id, title,
         list_filter(list_filter(regexp_extract_all(lower(title), '\\w+'), lambda t: length(t) >= 2),
                     lambda t: NOT list_contains(stop_words, t)) AS tokens,
         unnest(targets) AS target, brands, stop_words
  FROM parsed)"""


def plain_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as titles with one core term and one brand each."""
    part = spread(table(spark, folder, "part"))
    brand = F.regexp_replace("p_brand", "#", "")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.lower(F.concat_ws(" ", "p_name", brand, "p_type")).alias("product_name"),
        F.split("p_name", " ")[1].alias("core_terms"),
        F.lower(brand).alias("brand"),
        F.lower("p_type").alias("stop_words"),
    )


PLAIN_SQL = """
titles AS (
  SELECT p_partkey AS id,
         lower(p_name || ' ' || replace(p_brand, '#', '') || ' ' || p_type) AS product_name,
         split_part(p_name, ' ', 2) AS core_term,
         lower(replace(p_brand, '#', '')) AS brand,
         lower(p_type) AS stop_word
  FROM part)"""


def merged_sql(tokens: str) -> str:
    """SQL for tokens, 2-grams and 3-grams of a list expression."""
    two = f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    three = (
        f"list_transform(range(1, len({tokens}) - 1), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1] || ' ' || {tokens}[i + 2])"
    )
    return f"({tokens} || {two} || {three})"


def tokens_sql(text: str, min_len: int) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '\\w+'), lambda t: length(t) >= {min_len})"


def joined(column: str, out: str | None = None):
    """A list as text, so that results compare by value."""
    return F.array_join(column, "|").alias(out or column)

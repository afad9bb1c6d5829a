"""Predict new titles as they arrive (STR1-STR4, SNK5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from titlekit.functions.text import PREDICT_MIN_LEN
from titlekit.plans.predict import predict, predict_titles


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None,
                **options) -> DataFrame:
    """Files of a folder as a stream; the schema is given, not inferred (STR3)."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def predict_stream(titles: DataFrame, id_col: str | None, model: PipelineModel | None, terms: DataFrame, brands: DataFrame,
                   output_path: str, checkpoint_location: str, lexicon: DataFrame | None = None,
                   available_now: bool = True, min_len: int = PREDICT_MIN_LEN, whole_words: bool = False,
                   stop_words: DataFrame | None = None) -> StreamingQuery:
    """Start a query that predicts each micro-batch with the batch plan and writes it as Parquet (STR1, STR2).

    A batch has a folder of its own under that of the query, whose id lives in the checkpoint: a batch that is run again
    after a failure overwrites itself, and a query with a new checkpoint never touches what another has written. Rows
    keep ``id_col``, which may repeat; without it they are ``product_name, core_terms, brands``.
    """
    options = {"lexicon": lexicon, "min_len": min_len, "whole_words": whole_words, "stop_words": stop_words}

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        found = predict(batch, id_col, model, terms, brands, **options) if id_col else predict_titles(batch, model, terms, brands, **options)
        found.write.mode("overwrite").parquet(f"{output_path}/run={run}/batch={batch_id}")

    return run_batches(titles, write, checkpoint_location, available_now)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint_location: str,
                available_now: bool = True) -> StreamingQuery:
    """Start ``write`` on every micro-batch; progress is kept in ``checkpoint_location``."""
    writer = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class RowPrinter:
    """Print each streamed row where its task runs (SNK5, STR4); for ``writeStream.foreach``."""

    def __init__(self, show: Callable[[object], None] = print):
        self.show = show

    def open(self, partition_id: int, epoch_id: int) -> bool:
        return True

    def process(self, row) -> None:
        self.show(row)

    def close(self, error) -> None:
        pass

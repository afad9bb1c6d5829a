"""Prediction inside one streaming query, row by row, without micro-batch functions (STR1, STR2).

Every step is a list expression, a step of the fitted model, or a lookup in a measured set that travels to the tasks: no
join, no grouping, no state. A micro-batch is therefore one job, repeated and null titles need no key, and the rows are
those of the batch plan. Tables above the broadcast limits are refused; ``streaming.predict`` joins those batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from titlekit.functions.binding import bound
from titlekit.functions.lists import minimal_terms
from titlekit.functions.text import PREDICT_MIN_LEN
from titlekit.operators.lookup import fits_broadcast
from titlekit.plans.predict import title_features

#: Between term and brand of a pair; no token holds it.
BETWEEN = "\x00"


def _measured(table: DataFrame, said: str) -> pa.Table:
    if not fits_broadcast(table):
        raise ValueError(f"{said} do not fit a broadcast; use predict_stream")
    return table.toArrow()


def _hits(lists: pa.Array, values: pa.Array) -> list[list[str]]:
    """The items of each list that are among ``values``, each once, first seen first; only they become Python values."""
    items, offsets = lists.values, lists.offsets.to_pylist()
    found = pc.is_in(items, value_set=values).to_numpy(zero_copy_only=False)
    return [list(dict.fromkeys(items.take(pa.array(a + found[a:b].nonzero()[0])).to_pylist())) for a, b in zip(offsets, offsets[1:])]


def looked_up(rows: DataFrame, terms: pa.Array, pairs: pa.Array, brands: pa.Array, names: dict[int, str]) -> DataFrame:
    """``rows`` with what its columns ``_all`` (tokens) and ``prediction`` hold of the known tables.

    ``_predicted`` is the term of the predicted index, ``_found`` and ``_present`` the known terms and brands among the
    tokens, ``_pairs`` the known pairs of a term (found or predicted) and a present brand.
    """
    known = set(pairs.to_pylist())
    texts = pa.list_(pa.string())

    def batches(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            tokens = batch.column(batch.schema.get_field_index("_all"))
            found, present = _hits(tokens, terms), _hits(tokens, brands)
            index = batch.column(batch.schema.get_field_index("prediction")).to_pylist()
            predicted = [None if i is None else names.get(int(i)) for i in index]
            both = [[t + BETWEEN + b for t in dict.fromkeys([*f, *([p] if p else [])]) for b in bs if t + BETWEEN + b in known] for f, p, bs in zip(found, predicted, present)]
            made = [pa.array(predicted, pa.string()), *[pa.array(x, texts) for x in (found, present, both)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "_predicted", "_found", "_present", "_pairs"])

    schema = T.StructType([*rows.schema, T.StructField("_predicted", T.StringType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("_found", "_present", "_pairs")]])
    return rows.mapInArrow(batches, schema)


def predicted_rows(titles: DataFrame, model: PipelineModel | None, terms: DataFrame, brands: DataFrame, min_len: int = PREDICT_MIN_LEN,
                   whole_words: bool = False, stop_words: DataFrame | None = None) -> DataFrame:
    """``titles`` (a table or a stream with ``product_name``) and the lists ``core_terms`` and ``brands`` of each row.

    ``terms`` is ``label_index, term`` (``term`` alone without a model), ``brands`` the pairs ``term, brand``.
    """
    known = _strings(_measured(terms.select("term").where("term is not null").distinct(), "terms")["term"])
    named = brands.where("term is not null and brand is not null")
    pairs = _strings(_measured(named.select(F.concat_ws(BETWEEN, "term", "brand").alias("pair")).distinct(), "brands")["pair"])
    makers = _strings(_measured(named.select("brand").distinct(), "brands")["brand"])
    names: dict[int, str] = {}
    carried = titles.columns
    rows = title_features(titles, min_len).withColumn("_all", F.col("tokens"))
    if model is not None:
        if stop_words is not None:
            words = [w for w in _measured(stop_words.select("word").distinct(), "stop words")["word"].to_pylist() if w is not None]
            if words:
                remover = StopWordsRemover(inputCol="_all", outputCol="_seen", stopWords=words, caseSensitive=False, locale="en_US")
                rows = remover.transform(rows).withColumn("tokens", F.col("_seen")).drop("_seen")
        labels = _measured(terms.select("label_index", "term"), "terms")
        names = dict(zip(labels["label_index"].to_pylist(), labels["term"].to_pylist()))
        rows = model.transform(rows)
    else:
        rows = rows.withColumn("prediction", F.lit(None).cast("double"))
    rows = looked_up(rows.select(*carried, "_all", "prediction"), known, pairs, makers, names)
    first = F.when(F.array_contains("_all", F.col("_predicted")), F.array("_predicted")).otherwise(F.col("_found"))
    rows = rows.withColumn("core_terms", minimal_terms(F.coalesce(first, F.col("_found")), whole_words))
    paired = bound(lambda ts, bs, ps: F.filter(_combined(ts, bs), lambda p: F.array_contains(ps, p)), F.col("core_terms"), F.col("_present"), F.col("_pairs"))
    return rows.select(*carried, "core_terms", F.array_distinct(F.transform(paired, lambda p: F.substring_index(p, BETWEEN, -1))).alias("brands"))


def _strings(column: pa.ChunkedArray) -> pa.Array:
    return pa.array(column.to_pylist(), pa.string())


def _combined(terms: Column, brands: Column) -> Column:
    """Every pair of a term and a brand of one title, by place of the term, then by name of the brand."""
    ordered = F.array_sort(brands)
    return F.flatten(F.transform(terms, lambda t: F.transform(ordered, lambda b: F.concat(t, F.lit(BETWEEN), b))))


def predict_rows_stream(titles: DataFrame, model: PipelineModel | None, terms: DataFrame, brands: DataFrame, output_path: str,
                        checkpoint_location: str, available_now: bool = True, **options) -> StreamingQuery:
    """Start a query that writes the rows of ``predicted_rows`` as Parquet, each exactly once by the sink's own log."""
    out = predicted_rows(titles, model, terms, brands, **options)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_location).option("path", output_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

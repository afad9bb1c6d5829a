"""Core terms and brands of new titles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlekit.functions.lists import minimal_terms, priority_merge
from titlekit.functions.text import PREDICT_MIN_LEN, title_tokens, with_ngrams
from titlekit.operators.brands import brands_present, title_brands
from titlekit.operators.containment import minimal_lists
from titlekit.operators.gazetteer import checked_prediction, known_terms
from titlekit.operators.phrases import noun_phrases, phrase_candidates, tag_words, title_words
from titlekit.operators.vocabulary import index_to_term
from titlekit.plans.model import table_vectors, without_stop_words
from titlekit.session import materialise, partitioned, spread
from titlekit.sources.attributes import read_brands, read_model, read_stop_words, read_terms, read_vocabulary
from titlekit.sources.titles import read_unlabelled, write_results

REPEAT_ROWS = 100_000
#: Tokens and n-grams of a title from which on nested terms are settled by a join.
LONG_TITLE = 1_000


def title_features(titles: DataFrame, min_len: int = PREDICT_MIN_LEN) -> DataFrame:
    """Add ``tokens``: words, 2-grams and 3-grams of ``product_name``."""
    return titles.withColumn("tokens", title_tokens(F.col("product_name"), min_len)).withColumn("tokens", with_ngrams("tokens"))


def scored(titles: DataFrame, model: PipelineModel, id_col: str) -> DataFrame:
    """``id, product_name, tokens, prediction`` (ML10)."""
    return model.transform(titles).select(id_col, "product_name", "tokens", "prediction")


def core_terms(titles: DataFrame, id_col: str, terms: DataFrame, lexicon: DataFrame | None,
               whole_words: bool = False) -> DataFrame:
    """``id, product_name, core_terms`` from rows ``id, product_name, tokens, predicted_term``.

    The predicted term or, if the title does not have it, the known terms of the title come first; noun phrases that
    hold none of them follow; of nested terms the shortest remain.
    """
    found = known_terms(titles, id_col, "tokens", terms, out="_gazetteer")
    first = checked_prediction("predicted_term", F.col("tokens"), "_gazetteer")
    found = found.select(id_col, "product_name", F.coalesce(first, F.col("_gazetteer")).alias("_first"))
    none = F.array().cast("array<string>")

    def shortest(rows: DataFrame, column: str) -> DataFrame:
        """The titles are cached, so looking for one with very many tokens costs little."""
        if titles.where(F.size("tokens") > LONG_TITLE).isEmpty():
            out = rows.withColumn("core_terms", minimal_terms(column, whole_words))
        else:
            out = minimal_lists(rows, id_col, column, "core_terms", whole_words)
        return out.select(id_col, "product_name", "core_terms")

    if lexicon is None:
        return shortest(found, "_first")
    tagged = tag_words(title_words(titles, id_col, "product_name"), lexicon)
    second = phrase_candidates(noun_phrases(tagged, id_col), id_col, "_second")
    merged = found.join(second, id_col, "left").withColumn(
        "_merged", priority_merge("_first", F.coalesce("_second", none), whole_words)
    )
    return shortest(merged, "_merged")


def named_titles(titles: DataFrame, id_col: str, model: PipelineModel | None, terms: DataFrame,
                 min_len: int = PREDICT_MIN_LEN, stop_words: DataFrame | None = None, keep: tuple[str, ...] = (),
                 vocabulary: DataFrame | None = None) -> DataFrame:
    """``id, product_name, tokens, predicted_term`` and the columns ``keep``, cached and partitioned by ``id``.

    Without a model there is no predicted term, and the known terms of the title stand in for it. ``stop_words`` are
    taken from what the model sees, as in training; a ``vocabulary`` gives its vectors (``id`` is then unique). The caller drops the cache with ``unpersist``.
    """
    featured = title_features(titles.select(id_col, "product_name", *keep), min_len)
    if model is None:
        return partitioned(featured.withColumn("predicted_term", F.lit(None).cast("string")), id_col)
    seen = featured.withColumn("_tokens", F.col("tokens"))
    if stop_words is not None:
        seen = without_stop_words(seen, stop_words)
    if vocabulary is not None:
        seen = table_vectors(seen, id_col, vocabulary)
    predicted = model.transform(seen).select(id_col, "product_name", F.col("_tokens").alias("tokens"), "prediction", *keep)
    return partitioned(index_to_term(predicted, terms, out="predicted_term").drop("prediction"), id_col)


def predict_named(named: DataFrame, id_col: str, terms: DataFrame, brands: DataFrame, lexicon: DataFrame | None = None,
                  whole_words: bool = False) -> DataFrame:
    """``id, product_name, core_terms, brands`` as lists. All steps by title stay in the partitions of ``named``."""
    present = brands_present(named, id_col, "tokens", brands)
    return title_brands(core_terms(named, id_col, terms, lexicon, whole_words), id_col, "core_terms", present, brands)


def written_once(found: DataFrame, named: DataFrame) -> DataFrame:
    """``found`` written to the shared folder; the cache it was computed from is dropped."""
    try:
        return materialise(found)
    finally:
        named.unpersist()


def predict(titles: DataFrame, id_col: str, model: PipelineModel | None, terms: DataFrame, brands: DataFrame,
            lexicon: DataFrame | None = None, min_len: int = PREDICT_MIN_LEN, whole_words: bool = False,
            stop_words: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """``id, product_name, core_terms, brands`` as lists, one row for each row of ``titles``.

    Rows are numbered inside, so repeated and null ids are kept apart. The result is written down, and no cache stays.
    """
    rows = materialise(titles.select(F.col(id_col).alias("_id"), "product_name").withColumn("_title", F.monotonically_increasing_id()))
    named = named_titles(rows, "_title", model, terms, min_len, stop_words, ("_id",), vocabulary)
    found = predict_named(named, "_title", terms, brands, lexicon, whole_words)
    ids = named.select("_title", "_id")
    joined = found.join(ids, "_title").select(F.col("_id").alias(id_col), "product_name", "core_terms", "brands")
    return written_once(joined, named)


def predict_titles(titles: DataFrame, model: PipelineModel | None, terms: DataFrame, brands: DataFrame,
                   lexicon: DataFrame | None = None, **options) -> DataFrame:
    """``product_name, core_terms, brands`` for rows without a key.

    Equal titles have equal results, so titles are counted and each different one is predicted once; the count travels
    with it, and the result is repeated as often. Only titles above ``REPEAT_ROWS`` are cut into pieces that are spread
    over the tasks, so a title that fills a third of the table does not fall to one of them. Null titles have empty lists.
    """
    found = predicted_once(titles, model, terms, brands, lexicon, **options)
    often = found.where(F.col("_times") > REPEAT_ROWS)
    pieces = often.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / REPEAT_ROWS).cast("int"))))
    rest = F.least(F.lit(REPEAT_ROWS), F.col("_times") - F.col("_piece") * F.lit(REPEAT_ROWS))
    spread_out = pieces.repartition("product_name", "_piece").withColumn("_times", rest).drop("_piece")
    every = found.where(F.col("_times") <= REPEAT_ROWS).unionByName(spread_out)
    repeated = every.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("product_name", "core_terms", "brands")
    none = F.array().cast("array<string>")
    nameless = titles.where("product_name is null").select("product_name", none.alias("core_terms"), none.alias("brands"))
    return repeated.unionByName(nameless)


def predicted_once(titles: DataFrame, model: PipelineModel | None, terms: DataFrame, brands: DataFrame,
                   lexicon: DataFrame | None = None, min_len: int = PREDICT_MIN_LEN, whole_words: bool = False,
                   stop_words: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """``product_name, core_terms, brands, _times`` of each different title that is not null, written down."""
    counts = titles.where("product_name is not null").groupBy("product_name").agg(F.count(F.lit(1)).alias("_times"))
    keyed = counts.withColumn("_title", F.col("product_name"))
    named = named_titles(keyed, "_title", model, terms, min_len, stop_words, ("_times",), vocabulary)
    found = predict_named(named, "_title", terms, brands, lexicon, whole_words)
    return written_once(found.join(named.select("_title", "_times"), "_title").drop("_title"), named)


def predict_job(spark: SparkSession, input_path, model_path: str, brands_path: str, terms_path: str, output_path: str,
                lexicon: DataFrame | None = None, **options) -> None:
    """Predict from CSV files and write the results as CSV."""
    predicted = predict_titles(
        spread(read_unlabelled(spark, input_path)), read_model(model_path), read_terms(spark, terms_path),
        read_brands(spark, brands_path), lexicon, stop_words=read_stop_words(spark, model_path),
        vocabulary=read_vocabulary(spark, model_path), **options,
    )
    write_results(predicted, output_path)

"""Training from labelled titles to a model and two attribute tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlekit.operators.brands import brand_pairs
from titlekit.operators.lookup import lookup_join
from titlekit.operators.training import training_features
from titlekit.operators.vocabulary import term_vocabulary
from titlekit.plans.model import TermModel, train_term_model
from titlekit.session import materialise, spread
from titlekit.sources.attributes import stop_words_path, vocabulary_path, write_model, write_table
from titlekit.sources.titles import read_labelled


@dataclass
class Trained:
    term_model: TermModel
    brands: DataFrame
    terms: DataFrame


def train(labelled: DataFrame, folds: int = 10, metric: str = "f1", num_trees: int = 8, min_len: int = 2,
          seed: int = 0, min_term_count: int = 1, **stages) -> Trained:
    """Learn the term classifier, the (term, brand) pairs and the term vocabulary.

    The cost of the classifier grows with the number of terms. With ``min_term_count`` it learns only terms with that
    many titles; the tables keep all terms, and prediction still finds the rare ones by looking them up.
    """
    features = materialise(training_features(labelled, min_len, keep=("title",)).where("target is not null"))
    terms = materialise(term_vocabulary(features))
    learned = features
    if min_term_count > 1:
        frequent = terms.where(F.col("freq") >= min_term_count).select(F.col("term").alias("target"))
        learned = materialise(lookup_join(features, frequent, ["target"], "left_semi"))
    model = train_term_model(learned, folds, metric, num_trees, "title", seed, **stages)
    return Trained(model, brand_pairs(features), terms)


def train_job(spark: SparkSession, input_path, model_path: str, brands_path: str, terms_path: str, **options) -> Trained:
    """Train from CSV files and write the model and the tables; stop words go beside the model."""
    trained = train(spread(read_labelled(spark, input_path)), **options)
    write_model(trained.term_model.model, model_path)
    write_table(trained.term_model.stop_words, stop_words_path(model_path))
    # an empty one where the model needs none, so that no earlier model's is left there
    none = spark.createDataFrame([], "index bigint, token string, freq bigint")
    write_table(trained.term_model.vocabulary if trained.term_model.vocabulary is not None else none, vocabulary_path(model_path))
    write_table(trained.brands, brands_path)
    write_table(trained.terms, terms_path)
    return trained

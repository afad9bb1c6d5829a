"""The term classifier (ML1-ML10)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, HashingTF, StopWordsRemover, StringIndexer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlekit.functions.text import with_ngrams
from titlekit.operators.counts import as_vector, count_vectors, fit_vocabulary
from titlekit.operators.lookup import fits_broadcast, lookup_join
from titlekit.operators.training import corpus_stop_words, without_corpus_words
from titlekit.operators.vocabulary import numbered
from titlekit.session import materialise

HASHED_FEATURES = 1000
WHOLE_VOCABULARY = 2**31 - 1
#: Stop words that travel with the plan as a list.
STOP_WORD_ROWS = 100_000
STOP_WORD_BYTES = 4 * 1024 * 1024
#: What a task of a forest reads; Spark keeps a row as a number for each feature and each tree.
TASK_BYTES = 128 * 1024 * 1024
ROW_BYTES = 1024
#: Rows of a task that are left where they lie.
FEW_ROWS = 10_000


@dataclass
class TermModel:
    """The fitted stages, and the corpus stop words that are taken from tokens before them, as a table ``(word)``."""

    model: PipelineModel
    metric: float
    labels: list[str]
    stop_words: DataFrame
    #: ``index, token, freq`` of a model with ``vectors="table"``
    vocabulary: DataFrame | None = None


def term_stages(num_trees: int = 8, vectors: str = "counts", classifier: str = "forest", pca_k: int | None = None,
                default_stop_words: bool = False, vocab_size: int | None = None, hashed_features: int = HASHED_FEATURES,
                seed: int = 0) -> Pipeline:
    """Vector and classifier over the column ``tokens`` (ML2-ML4; ML6-ML8 and TXT4 as options).

    All tokens are counted unless ``vocab_size`` keeps only the most frequent ones; the vocabulary is part of the saved
    model, so for very many tokens either give ``vocab_size`` or take ``vectors="hashed"`` or ``vectors="table"``. With
    "table" the stages expect the column ``features``, which ``table_vectors`` makes from a vocabulary that is a table.
    """
    if vectors == "table":
        if default_stop_words or vocab_size:
            raise ValueError("vectors from a table take neither default stop words nor a vocabulary size")
        return Pipeline(stages=_classifier([], "features", classifier, pca_k, num_trees, seed))
    words = StopWordsRemover.loadDefaultStopWords("english") if default_stop_words else [""]
    remover = StopWordsRemover(inputCol="tokens", outputCol="clean_tokens", stopWords=words)
    if vectors == "counts":
        vector = CountVectorizer(inputCol="clean_tokens", outputCol="features", vocabSize=vocab_size or WHOLE_VOCABULARY)
    elif vectors == "hashed":
        vector = HashingTF(inputCol="clean_tokens", outputCol="features", numFeatures=hashed_features)
    else:
        raise ValueError("vectors is 'counts' or 'hashed'")
    return Pipeline(stages=_classifier([remover, vector], "features", classifier, pca_k, num_trees, seed))


def _classifier(stages: list, column: str, classifier: str, pca_k: int | None, num_trees: int, seed: int) -> list:
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=column, outputCol="components"))
        column = "components"
    if classifier == "forest":
        stages.append(RandomForestClassifier(featuresCol=column, labelCol="label", numTrees=num_trees, seed=seed))
    elif classifier == "one_vs_rest":
        stages.append(OneVsRest(classifier=LogisticRegression(), featuresCol=column, labelCol="label"))
    else:
        raise ValueError("classifier is 'forest' or 'one_vs_rest'")
    return stages


def table_vectors(rows: DataFrame, id_col: str, vocabulary: DataFrame) -> DataFrame:
    """``rows`` (unique by ``id``) with ``features``, the counts of ``tokens`` by the vocabulary's index."""
    size = vocabulary.agg(F.max("index")).first()[0]
    counted = count_vectors(rows, id_col, "tokens", vocabulary, "_counts")
    return counted.withColumn("features", as_vector("_counts", (-1 if size is None else size) + 1)).drop("_counts")


def dealt_to_tasks(rows: DataFrame, num_trees: int, width: int | None = None) -> DataFrame:
    """Training rows, written down before, in as many parts as a bounded part for each task needs.

    ``width`` is the number of features; without it the different ``tokens`` are counted.
    """
    held = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    total, largest = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if largest <= FEW_ROWS:
        return rows
    if width is None:
        width = rows.select(F.explode("tokens").alias("token")).agg(F.approx_count_distinct("token")).first()[0]
    limit = max(1, TASK_BYTES // (4 * width + 4 * num_trees + ROW_BYTES))
    return rows if largest <= limit else materialise(rows.repartition(-(-total // limit)))


def indexed(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add ``label``, the place of the target by frequency, then by name (ML1).

    The classifier keeps its classes as a list on the driver; ``train`` can leave rare terms to the lookup.
    """
    indexer = StringIndexer(inputCol="target", outputCol="label", stringOrderType="frequencyDesc").fit(features)
    return indexer.transform(features), list(indexer.labels)


def halves(features: DataFrame, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Random 70/30 split (ML9)."""
    train, test = features.randomSplit([0.7, 0.3], seed)
    return train, test


def without_stop_words(titles: DataFrame, stop_words: DataFrame) -> DataFrame:
    """``titles`` with the stop words taken out of ``tokens``, in any case; the same step in training and in prediction.

    Words that fit a small measured list leave the tokens where they lie (TXT5); more of them meet the exploded tokens by
    an anti-join. Both give the same tokens in the same order.
    """
    if fits_broadcast(stop_words, STOP_WORD_ROWS, STOP_WORD_BYTES):
        words = [r["word"] for r in stop_words.distinct().collect() if r["word"] is not None]
        if not words:
            return titles
        remover = StopWordsRemover(inputCol="tokens", outputCol="_kept", stopWords=words, caseSensitive=False, locale="en_US")
        return remover.transform(titles).withColumn("tokens", F.col("_kept")).drop("_kept")
    keyed = materialise(titles.withColumn("_row", F.monotonically_increasing_id()))
    kept = without_corpus_words(keyed, "_row", "tokens", stop_words, "_kept")
    return kept.withColumn("tokens", F.col("_kept")).drop("_row", "_kept")


def dealt(rows: DataFrame, fold_key: str, folds: int) -> tuple[DataFrame, int]:
    """Add ``fold``: the different keys are numbered in hash order and dealt out in turn, so no fold is empty.

    With fewer keys than folds there are as many folds as keys.
    """
    keys = materialise(rows.select(fold_key).distinct())
    folds = max(2, min(folds, keys.count()))
    placed = numbered(keys, [F.xxhash64(fold_key), F.col(fold_key)], "_place")
    places = materialise(placed.select(fold_key, F.pmod("_place", F.lit(folds)).cast("int").alias("fold")))
    return lookup_join(rows, places, [fold_key]), folds


def out_of_fold(rows: DataFrame, estimator: Pipeline, folds: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., fold, label, prediction``: every row scored by the model that was fitted without its ``fold`` (ML5)."""
    out = None
    for fold in range(folds):
        model = estimator.fit(rows.where(F.col("fold") != fold))
        scored = model.transform(rows.where(F.col("fold") == fold)).select(*keep, "fold", "label", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


def _width(stages: dict, vocabulary: DataFrame | None) -> int | None:
    """Numbers of a row that the classifier sees, where the options tell."""
    if stages.get("pca_k") or stages.get("vectors") == "hashed":
        return stages.get("pca_k") or stages.get("hashed_features") or HASHED_FEATURES
    return vocabulary.count() if vocabulary is not None else stages.get("vocab_size")


def train_term_model(features: DataFrame, folds: int = 10, metric: str = "f1", num_trees: int = 8,
                     fold_key: str = "title", seed: int = 0, **stages) -> TermModel:
    """Cross-validate and fit the classifier on rows ``tokens, target, stop_words`` (ML1-ML5).

    All rows of one ``fold_key`` go to one fold, so the score is not helped by copies of a title. The rows are written
    down once, because every fold reads them.
    """
    words = materialise(corpus_stop_words(features))
    labelled, labels = indexed(features)
    rows, folds = dealt(labelled.select(fold_key, "label", with_ngrams("tokens").alias("tokens")), fold_key, folds)
    rows = materialise(without_stop_words(rows, words).select("label", "tokens", "fold"))
    vocabulary = None
    if stages.get("vectors") == "table":
        keyed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
        vocabulary = fit_vocabulary(keyed)
        rows = materialise(table_vectors(keyed, "_row", vocabulary).select("label", "features", "fold"))
    rows = dealt_to_tasks(rows, num_trees, _width(stages, vocabulary))
    validator = CrossValidator(
        estimator=term_stages(num_trees, seed=seed, **stages),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=metric),
        numFolds=folds, foldCol="fold", seed=seed,
    )
    fitted = validator.fit(rows)
    return TermModel(fitted.bestModel, fitted.avgMetrics[0], labels, words, vocabulary)

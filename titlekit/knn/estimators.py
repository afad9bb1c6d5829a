"""Spark ML estimators over the neighbour search (KNN9-KNN13)."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlekit.knn.cells import CellIndex, fit_cells
from titlekit.knn.predict import class_count, classified, regressed
from titlekit.knn.probing import DEFAULT_RECALL
from titlekit.knn.search import DEFAULT_K, knn_cells, knn_exact_pruned, with_neighbors
from titlekit.knn.stored import StoredIndex, open_index, search_stored, store_index
from titlekit.knn.tau import SAMPLE_SIZES
from titlekit.session import materialise

ROW_KEY = "_row_key"
AUX = "_aux_{}"


class KNNParams(HasFeaturesCol, HasSeed):
    """Parameters shared by the estimators and their models."""

    idCol = Param(Params._dummy(), "idCol", "unique key of a row; empty: rows are written down and numbered", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    inputCols = Param(Params._dummy(), "inputCols", "columns of the training rows to return", TypeConverters.toListString)
    neighborsCol = Param(Params._dummy(), "neighborsCol", "list of neighbours", TypeConverters.toString)
    distanceCol = Param(Params._dummy(), "distanceCol", "list of distances; empty: none", TypeConverters.toString)
    maxDistance = Param(Params._dummy(), "maxDistance", "greatest distance of a neighbour", TypeConverters.toFloat)
    topTreeSize = Param(Params._dummy(), "topTreeSize", "points sampled for the tree", TypeConverters.toInt)
    topTreeLeafSize = Param(Params._dummy(), "topTreeLeafSize", "sampled points in a cell", TypeConverters.toInt)
    subTreeLeafSize = Param(Params._dummy(), "subTreeLeafSize", "sampled points in a cell that is split again", TypeConverters.toInt)
    bufferSize = Param(Params._dummy(), "bufferSize", "tau; negative: estimated", TypeConverters.toFloat)
    bufferSizeSampleSizes = Param(Params._dummy(), "bufferSizeSampleSizes", "sample sizes of the estimate", TypeConverters.toListInt)
    balanceThreshold = Param(Params._dummy(), "balanceThreshold", "greatest share of a child of an overlapping node", TypeConverters.toFloat)
    spill = Param(Params._dummy(), "spill", "'query' or 'train': which side is copied near a boundary", TypeConverters.toString)
    copies = Param(Params._dummy(), "copies", "rows of equal vectors that the index keeps; 0: all. A fitted model then takes any k up to it", TypeConverters.toInt)
    recall = Param(Params._dummy(), "recall", "share of the true neighbours that a search with estimated buffer finds", TypeConverters.toFloat)
    indexPath = Param(Params._dummy(), "indexPath", "folder where the index is kept as tables for other sessions; empty: in this session only", TypeConverters.toString)
    exact = Param(Params._dummy(), "exact", "visit every cell that may hold a neighbour", TypeConverters.toBoolean)

    def _defaults(self) -> None:
        self._setDefault(
            idCol="", k=DEFAULT_K, inputCols=[], neighborsCol="neighbors", distanceCol="", maxDistance=math.inf,
            topTreeSize=1000, topTreeLeafSize=10, subTreeLeafSize=30, bufferSize=-1.0,
            bufferSizeSampleSizes=list(SAMPLE_SIZES), balanceThreshold=0.7, spill="query", copies=0, recall=DEFAULT_RECALL, indexPath="", exact=False, seed=0,
        )

    def set(self, param, value):
        """Chainable setter by parameter or its name."""
        self._set(**{param if isinstance(param, str) else param.name: value})
        return self

    def _check(self) -> None:
        """Refuse values that make no sense, at fitting and at every use."""
        get = self.getOrDefault
        for bad, said in (
            (get("k") < 1, "k is at least 1"),
            (not get("maxDistance") > 0, "maxDistance is above 0"),
            (get("bufferSize") < 0 and get("bufferSize") != -1, "bufferSize is -1 (estimated) or at least 0"),
            (min(get("topTreeSize"), get("topTreeLeafSize"), get("subTreeLeafSize")) < 1, "sizes of trees and leaves are at least 1"),
            (len(get("bufferSizeSampleSizes")) < 2 or min(get("bufferSizeSampleSizes"), default=0) < 1, "at least two positive sample sizes"),
            (not 0 <= get("balanceThreshold") <= 1, "balanceThreshold is from 0 to 1"),
            (get("spill") not in ("query", "train"), "spill is 'query' or 'train'"),
            (get("copies") < 0, "copies is at least 0"),
            (not 0 < get("recall") <= 1, "recall is above 0 and at most 1"),
        ):
            if bad:
                raise ValueError(said)

    def _keyed(self, df: DataFrame) -> tuple[DataFrame, str]:
        key = self.getOrDefault("idCol")
        if key:
            return df, key
        return materialise(df.withColumn(ROW_KEY, F.monotonically_increasing_id())), ROW_KEY

    def _index(self, df: DataFrame, aux: tuple[str, ...]) -> CellIndex | StoredIndex:
        """The index of the training rows; the columns ``aux`` travel under names of their own, so any may be asked for.

        An index in a folder has a tree of its own kind; the parameters of trees, buffers and copies do not bear on it.
        """
        self._check()
        rows, key = self._keyed(df)
        get = self.getOrDefault
        own = [F.col(c).alias(AUX.format(i)) for i, c in enumerate(aux)]
        rows = rows.select(F.col(key).alias(ROW_KEY), F.col(get("featuresCol")).alias("_features"), *own)
        names = tuple(AUX.format(i) for i in range(len(aux)))
        if get("indexPath"):
            return store_index(rows, get("indexPath"), ROW_KEY, "_features", names, seed=get("seed"))
        return fit_cells(
            rows, ROW_KEY, "_features", names, top_tree_size=get("topTreeSize"),
            top_tree_leaf_size=get("topTreeLeafSize"), sub_tree_leaf_size=get("subTreeLeafSize"),
            buffer_size=get("bufferSize"), buffer_size_sample_sizes=get("bufferSizeSampleSizes"),
            balance_threshold=get("balanceThreshold"), spill=get("spill"), seed=get("seed"), copies=get("copies") or None,
        )


class _KNNModelBase(Model, KNNParams):
    def __init__(self, index: CellIndex | None = None):
        super().__init__()
        self._defaults()
        self.index = index

    def copy(self, extra=None):
        copied = super().copy(extra)
        copied.index = self.index
        return copied

    def _found(self, rows: DataFrame, key: str) -> DataFrame:
        self._check()
        get = self.getOrDefault
        if isinstance(self.index, StoredIndex):
            probes = self.index.cells.count() if get("exact") else None
            return search_stored(self.index, rows, key, get("featuresCol"), get("k"), get("maxDistance"), get("recall"), probes)
        if get("exact"):
            return knn_exact_pruned(self.index, rows, key, get("featuresCol"), get("k"), get("maxDistance"))
        tau = get("bufferSize") if self.isSet("bufferSize") and get("bufferSize") >= 0 else None
        recall = get("recall") if tau is None and self.index.estimated else None
        return knn_cells(self.index, rows, key, get("featuresCol"), get("k"), get("maxDistance"), tau, recall)

    def release(self) -> None:
        """Drop the cached training rows; an index in a folder stays there."""
        if isinstance(self.index, CellIndex):
            self.index.release()

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, **params):
        """The model of an index in a folder, with the parameters that it was fitted with."""
        model = cls(open_index(spark, folder))
        model._set(**params)
        return model


class KNNModel(_KNNModelBase):
    """Adds each row's neighbours, nearest first, and optionally their distances."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, key = self._keyed(dataset)
        get = self.getOrDefault
        found = self._found(rows, key)
        named = tuple(F.col(a).alias(c) for a, c in zip(self.index.aux, get("inputCols"))) or (F.col("tid"),)
        out = with_neighbors(rows, found, key, named, get("neighborsCol"), get("distanceCol") or None)
        return out.drop(ROW_KEY)


class KNN(Estimator, KNNParams):
    """Estimator of ``KNNModel``."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNModel:
        model = KNNModel(self._index(dataset, tuple(self.getOrDefault("inputCols"))))
        return self._copyValues(model)


class _Supervised(KNNParams, HasLabelCol, HasPredictionCol):
    weightCol = Param(Params._dummy(), "weightCol", "weight of a training row; empty: 1", TypeConverters.toString)

    def _aux(self) -> tuple[str, ...]:
        weight = self.getOrDefault("weightCol")
        return (self.getOrDefault("labelCol"), weight) if weight else (self.getOrDefault("labelCol"),)


class KNNClassificationModel(_KNNModelBase, _Supervised):
    """Adds raw votes, probabilities and the predicted class."""

    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "votes by class", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "share of the votes by class", TypeConverters.toString)

    def __init__(self, index: CellIndex | None = None, num_classes: int = 0):
        super().__init__(index)
        self._setDefault(weightCol="", rawPredictionCol="rawPrediction", probabilityCol="probability")
        self.numClasses = num_classes

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, **params):
        model = super().opened(spark, folder, **params)
        model.numClasses = class_count(model.index.rows, AUX.format(0))
        return model

    def copy(self, extra=None):
        copied = super().copy(extra)
        copied.numClasses = self.numClasses
        return copied

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, key = self._keyed(dataset)
        get = self.getOrDefault
        scored = classified(rows.select(key), self._found(rows, key), self.numClasses, key, AUX.format(0), AUX.format(1) if get("weightCol") else None)
        made = (
            ("rawPredictionCol", array_to_vector(scored["raw"])),
            ("probabilityCol", array_to_vector(scored["probability"])),
            ("predictionCol", scored["prediction"]),
        )
        out = scored.select(key, *[c.alias(get(name)) for name, c in made if get(name)])
        return rows.join(out, key, "left").drop(ROW_KEY)


class KNNClassifier(Estimator, _Supervised):
    """Estimator of ``KNNClassificationModel``; labels are 0, 1, 2, ..."""

    rawPredictionCol = KNNClassificationModel.rawPredictionCol
    probabilityCol = KNNClassificationModel.probabilityCol

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults()
        self._setDefault(weightCol="", rawPredictionCol="rawPrediction", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNClassificationModel:
        classes = class_count(dataset, self.getOrDefault("labelCol"))
        return self._copyValues(KNNClassificationModel(self._index(dataset, self._aux()), classes))


class KNNRegressionModel(_KNNModelBase, _Supervised):
    """Adds the weighted mean label of the neighbours."""

    def __init__(self, index: CellIndex | None = None):
        super().__init__(index)
        self._setDefault(weightCol="")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, key = self._keyed(dataset)
        get = self.getOrDefault
        if not get("predictionCol"):
            return rows.drop(ROW_KEY)
        means = regressed(rows.select(key), self._found(rows, key), key, AUX.format(0), AUX.format(1) if get("weightCol") else None)
        return rows.join(means.withColumnRenamed("prediction", get("predictionCol")), key, "left").drop(ROW_KEY)

    def predict(self, spark, vector) -> float | None:
        """Prediction for one vector, as a one-row job (KNN12)."""
        from pyspark.ml.linalg import Vector

        values = [float(x) for x in (vector.toArray() if isinstance(vector, Vector) else vector)]
        one = spark.createDataFrame([(0, values)], f"qid long, `{self.getOrDefault('featuresCol')}` array<double>")
        found = self._found(one, "qid")
        weight = AUX.format(1) if self.getOrDefault("weightCol") else None
        return regressed(one.select("qid"), found, "qid", AUX.format(0), weight).first()["prediction"]


class KNNRegression(Estimator, _Supervised):
    """Estimator of ``KNNRegressionModel``."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults()
        self._setDefault(weightCol="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNRegressionModel:
        return self._copyValues(KNNRegressionModel(self._index(dataset, self._aux())))

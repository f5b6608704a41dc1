"""Classifiers, grid search, and evaluation as tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import stored
from .ranking import running
from .sampling import split_bucket
from .trees import Binned, Shape, SparseForest, Tree, votes

# The inverse penalties and tree settings that are searched.
LR_C = (0.01, 0.033, 0.1, 0.33, 1.0)
SVM_C = (0.01, 0.1, 1.0, 10.0, 33.0, 100.0)
FOREST = {"numTrees": [90], "maxDepth": [30], "featureSubsetStrategy": ["50", "75", "100"], "minInstancesPerNode": [2, 3]}
BOOST = {"maxIter": [60], "maxDepth": [2], "stepSize": [0.8]}
GBT = BOOST


#: Terms of a bag of words: as many as a vector can have, so that none at or over min_df is dropped.
MAX_TERMS = 2**31 - 1

#: Bytes of stored features that a task of a learner has at most, about.
PART_BYTES = 64 << 20


def estimator(name: str, seed: int = 0, features: str = "features", label: str = "label") -> Estimator:
    own = {"featuresCol": features, "labelCol": label}
    if name == "lr":
        return LogisticRegression(**own)
    if name == "svm":
        return LinearSVC(**own)
    if name == "random_forest":
        return SparseForest(**own, seed=seed, bootstrap=False)
    if name == "boost":
        return AdaBoost(seed=seed, **own)
    if name == "gbt":
        return GBTClassifier(**own, seed=seed)
    raise ValueError(f"no such classifier: {name}")


def grid(name: str, model: Estimator, rows: int, values: dict | None = None) -> list:
    """The settings that are tried; penalties are 1 / (rows * C)."""
    b = ParamGridBuilder()
    if values is None:
        values = {"lr": {"regParam": [1 / (rows * c) for c in LR_C], "elasticNetParam": [0.0, 1.0]}, "svm": {"regParam": [1 / (rows * c) for c in SVM_C]}, "random_forest": FOREST, "boost": BOOST, "gbt": GBT}[name]
    for k, v in values.items():
        b = b.addGrid(model.getParam(k), v)
    return b.build()


def feature_stages(features: tuple[str, ...], tokens: str = "tokens", embedding: str = "embedding", weights: dict[str, float] | None = None, min_df: float = 1.0) -> list:
    """Stages to the column `features`: tf-idf of a tokens column (fitted within each fold), an embedding, or both.

    weights: of the parts; 1 if left out.
    """
    weights = weights or {}
    stages, parts = [], []
    if "embedding" in features:
        by = weights.get("embedding", 1.0)
        stages.append(ColumnStage(lambda df: df.withColumn("__embedding", array_to_vector(F.transform(embedding, lambda x: x.cast("double") * by)))))
        parts.append("__embedding")
    if "bow" in features:
        stages += [CountVectorizer(inputCol=tokens, outputCol="__tf", minDF=min_df, vocabSize=MAX_TERMS), SmoothedIDF(), Normalizer(inputCol="__tfidf", outputCol="__bow", p=2.0)]
        parts.append("__bow")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


class ColumnStage(Transformer):
    """A function of DataFrames as a pipeline stage."""

    def __init__(self, f: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.f = f

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.f(dataset)


class SmoothedIDF(Estimator):
    """tf * (idf + 1) of sparse vectors, which stay sparse; idf is fitted on the table that fit() gets."""

    def _fit(self, dataset: DataFrame) -> Transformer:
        idf = IDF(inputCol="__tf", outputCol="__idf").fit(dataset).idf.toArray()
        return ElementwiseProduct(scalingVec=Vectors.dense(idf + 1), inputCol="__tf", outputCol="__tfidf")


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasSeed):
    """Discrete multi-class boosting (SAMME) of shallow trees: each tree is fitted with the rows' weights, which grow
    where it errs. maxIter trees of maxDepth; stepSize shrinks each tree's vote."""

    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", maxIter: int = 60, maxDepth: int = 2, stepSize: float = 0.8, seed: int = 0):
        super().__init__()
        self._setDefault(maxIter=60, maxDepth=2, stepSize=0.8, seed=0)
        self._set(featuresCol=featuresCol, labelCol=labelCol, maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, seed=seed)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        rows = Binned(dataset, self.getFeaturesCol(), self.getLabelCol())
        classes, model = rows.classes, AdaBoostModel([], [], self.getFeaturesCol(), rows.classes)
        for _ in range(self.getMaxIter()):
            # A row's weight follows from the votes that erred on it, so that nothing but the trees is kept between rounds.
            (own,) = rows.grow([Shape(None, 1e-300, self.getOrDefault(self.maxDepth), self.getSeed())], list(zip(model.trees, model.votes)))
            totals = np.array(own.totals)
            error = 1 - totals.max(axis=1).sum() / totals.sum()
            if error >= 1 - 1 / classes:
                break
            vote = self.getStepSize() * (math.log((1 - error) / max(error, 1e-12)) + math.log(classes - 1))
            model = AdaBoostModel([*model.trees, own], [*model.votes, vote], self.getFeaturesCol(), classes)
            if error <= 1e-12:
                break
        rows.release()
        return model


class AdaBoostModel(Model):
    """prediction and rawPrediction (votes of each class)."""

    def __init__(self, trees: list[Tree], votes: list[float], features: str, classes: int):
        super().__init__()
        self.trees, self.votes, self.features, self.classes = trees, votes, features, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = [v * np.eye(self.classes)[t.probabilities().argmax(axis=1)] for t, v in zip(self.trees, self.votes)]
        out = dataset.withColumn("__votes", votes(self.trees, weights, self.classes, self.features))
        best = (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")
        return out.withColumns({"prediction": best, "rawPrediction": array_to_vector("__votes")}).drop("__votes")


def search(train: DataFrame, name: str, *, features: list | None = None, folds: int = 5, scoring: str = "accuracy", values: dict | None = None, seed: int = 0, parallelism: int = 2, key: str | None = None) -> CrossValidatorModel:
    """The best of a grid by cross validation, fitted again on all of train (label, and features or what feature stages need).

    Feature stages are fitted once a fold, on its training rows, and each point of the grid on what they give, stored (see
    made_features()). key: rows' folds follow from its digest (see fold()); without it they are drawn.
    """
    model = estimator(name, seed)
    part = fold(key, folds, seed) if key else F.floor(F.rand(seed) * folds)
    train = train.withColumn("__fold", part).persist()  # each fold reads it
    maps = grid(name, model, train.count(), values)
    metric = BinaryClassificationEvaluator(labelCol="label") if scoring == "roc_auc" else MulticlassClassificationEvaluator(labelCol="label", metricName=scoring)
    stages = Pipeline(stages=features or [])
    marks = np.zeros((folds, len(maps)))
    for i in range(folds):
        fit, held = (train.where(c) for c in (F.col("__fold") != i, F.col("__fold") == i))
        made = stages.fit(fit)
        fit, held = (made_features(made, x).persist() for x in (fit, held))

        many = model.fit_many(fit, maps) if isinstance(model, SparseForest) else None  # trees of all points grow together

        def mark(j: int) -> float:
            return metric.evaluate((many[j] if many else model.fit(fit, maps[j])).transform(held))

        with ThreadPoolExecutor(parallelism) as pool:
            marks[i] = list(pool.map(inheritable_thread_target(train.sparkSession)(mark), range(len(maps))))
        fit.unpersist()
        held.unpersist()
    mean = marks.mean(axis=0)
    best = int(mean.argmax() if metric.isLargerBetter() else mean.argmin())
    whole = train.drop("__fold")
    made = stages.fit(whole)
    final = PipelineModel([*made.stages, model.fit(made_features(made, whole), maps[best])])
    train.unpersist()
    search = CrossValidator(estimator=Pipeline(stages=[*(features or []), model]), estimatorParamMaps=maps, evaluator=metric, numFolds=folds, seed=seed)
    return search._copyValues(CrossValidatorModel(final, avgMetrics=mean.tolist(), stdMetrics=marks.std(axis=0).tolist()))


def made_features(made: PipelineModel, rows: DataFrame) -> DataFrame:
    """features, label of rows by fitted stages, stored. The names of all features, which the stages put into the schema, are
    left out, and so are the stages: each of a learner's many jobs would take both, as large as the vocabulary, to its tasks.
    A task a core, or more if it would have over PART_BYTES of files, as each sends sums of all features on."""
    out = stored(made.transform(rows).select(F.col("features").alias("features", metadata={"ml_attr": {}}), "label"))
    size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return out.coalesce(max(out.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES)))


def search_report(model: CrossValidatorModel) -> DataFrame:
    """setting, mean, deviation of each point of the grid."""
    from pyspark.sql import SparkSession

    rows = [(", ".join(f"{k.name}={v}" for k, v in m.items()), float(a), float(s)) for m, a, s in zip(model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics)]
    return SparkSession.active().createDataFrame(rows, "setting string, mean double, deviation double")


def classification_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, precision, recall, f1, support of each class, and their means by support (label null)."""
    pairs = predicted.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).agg(F.count("*").alias("n"))
    real = pairs.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    said = pairs.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("said"))
    rows = real.join(said, "y", "left").na.fill(0, ["said"])
    precision, recall = F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    rows = rows.select(F.col("y").alias("label"), precision.alias("precision"), recall.alias("recall"), "support")
    rows = rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    total = rows.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support")).withColumn("label", F.lit(None).cast("double"))
    columns = ["label", "precision", "recall", "f1", "support"]
    return rows.select(columns).unionByName(total.select(columns))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", places: int | None = None) -> DataFrame:
    """threshold, fpr, tpr, and the step before's fpr_before, tpr_before: a row per distinct score, from the highest.
    places: scores are rounded to so many first. Scores are counted, and the counts summed by ranges (see ranking)."""
    s = F.round(F.col(score).cast("double"), places) if places is not None else F.col(score).cast("double")
    counts = scored.groupBy(s.alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    whole = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    out = running(counts, "threshold", {"tp": "pos", "fp": "neg"}, descending=True).crossJoin(F.broadcast(whole))
    rate = lambda n, all_: F.try_divide(n, F.col(all_))
    fp, tp = F.col("fp"), F.col("tp")
    return out.select("threshold", rate(fp, "all_neg").alias("fpr"), rate(tp, "all_pos").alias("tpr"), rate(fp - F.col("neg"), "all_neg").alias("fpr_before"), rate(tp - F.col("pos"), "all_pos").alias("tpr_before"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """auc: the area under a curve by trapezoids, from (0, 0)."""
    return curve.agg(F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2).alias("auc"))


def feature_importance(train: DataFrame, names: list[str] | None = None, k: int = 25, trees: int = 60, seed: int = 0) -> DataFrame:
    """rank, feature, importance, deviation (over trees) of the k features that matter most to a forest."""
    mean, spread = SparseForest(numTrees=trees, seed=seed).fit(train).importances()
    top = np.argsort(-mean, kind="stable")[:k]
    rows = [(r + 1, names[i] if names else str(i), float(mean[i]), float(spread[i])) for r, i in enumerate(top)]
    return train.sparkSession.createDataFrame(rows, "rank int, feature string, importance double, deviation double")


def fold(key: str, folds: int = 5, seed: int = 0):
    """A fold from a key's digest, the same however rows are dealt."""
    return split_bucket(key, seed) % folds


def check_features(features: tuple[str, ...], embedding: DataFrame | None) -> str:
    """Which way features are made: bow, embedding or both."""
    if embedding is None and "embedding" in features:
        raise RuntimeError("these features need an embedding")
    return "both" if {"bow", "embedding"} <= set(features) else "embedding" if "embedding" in features else "bow"

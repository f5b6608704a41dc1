import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textloom.operators import classify as C
from textloom.operators import trees as T
from textloom.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.choice([-2.0, 0, 0, 0, 1, 3.5], size=(700, 7))
    y = ((x[:, 0] > 0) ^ (x[:, 1] < 0)) | (x[:, 2] > 2) | (r.random(700) < 0.1)
    kinds = (lambda v: Vectors.dense(v), lambda v: Vectors.sparse(7, {i: a for i, a in enumerate(v) if a}))
    data = [(i, kinds[i % 2](v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["id", "features", "label"]).repartition(3, "id").cache()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_one_tree_is_spark_s(rows, depth):
    theirs = DecisionTreeClassifier(maxDepth=depth).fit(rows).transform(rows)
    own = T.SparseForest(numTrees=1, bootstrap=False)
    own._set(maxDepth=depth, featureSubsetStrategy="all")
    ours = own.fit(rows).transform(rows)
    both = ours.select("id", "prediction", F.col("probability").alias("p")).join(theirs.select("id", F.col("prediction").alias("other"), F.col("probability").alias("q")), "id").collect()
    assert len(both) == 700 and all(r["prediction"] == r["other"] for r in both)
    # Spark puts leaves beside each other that say the same together, which deeper trees have.
    assert depth > 2 or all(np.allclose(r["p"].toArray(), r["q"].toArray()) for r in both)


def test_boosting_weighs_rows(rows):
    misses = []
    for n in (1, 12):
        model = C.AdaBoost(maxIter=n, maxDepth=2).fit(rows)
        misses.append(model.transform(rows).where("prediction <> label").count())
        assert len(model.trees) <= n
    assert misses[1] <= misses[0] and model.trees[0].splits != model.trees[1].splits


def test_forests_of_very_many_features(spark):
    size = 40_000_000  # 160 MB a row, were it unrolled
    data = [(Vectors.sparse(size, {i % 2: 1.0, 1000 * (i + 1): 0.5}), float(i % 2)) for i in range(300)]
    wide = spark.createDataFrame(data, ["features", "label"]).repartition(4).cache()
    boost = C.AdaBoost(maxIter=2, maxDepth=2).fit(wide)
    assert boost.transform(wide).where("prediction <> label").count() == 0
    forest = T.SparseForest(numTrees=3)
    forest._set(featureSubsetStrategy="100", maxDepth=3)
    assert len(forest.fit(wide).trees) == 3


def test_the_grid_of_the_forest_is_whole(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries.classify, "search", lambda *a, values, **k: asked.append(values))
    monkeypatch.setattr(queries.classify, "search_report", lambda m: None)
    queries.QUERIES["grid_search_random_forest"](spark, "/root/testdata/sf0.001")
    assert asked == [None] and len(C.grid("random_forest", C.estimator("random_forest"), 1)) == 6

"""The forest trainer: work by rows, not by (feature, bin, class) tables of small nodes."""

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from alertloom.operators import forest as G, identifier as I


def labelled(spark, n, columns="abcd"):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        x = [rnd.random() for _ in columns]
        label = rnd.randrange(3) if rnd.random() < 0.3 else int(x[0] > 0.5) + int(x[1] > 0.4)
        rows.append((str(label), *x))
    return spark.createDataFrame(rows, f"label string, {', '.join(f'{c} double' for c in columns)}").repartition(3)


def forest_of(model):
    return next(s for s in model.stages if hasattr(s, "featureImportances"))


def test_deeper_forests_need_no_more_jobs(spark, monkeypatch):
    monkeypatch.setattr(G, "TABLE_MB", 0)
    rows, jobs = labelled(spark, 400), {}
    for depth in (3, 12):
        spark.sparkContext.setJobGroup(f"depth {depth}", "")
        model = I.train_identifier(rows, rows, list("abcd"), trees=6, depth=depth, min_leaf=2)
        jobs[depth] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}"))
        assert max(t.depth for t in forest_of(model).trees) == depth
    assert jobs[12] <= jobs[3] + 2, jobs


def test_large_nodes_are_split_alike(spark, monkeypatch):
    """Tables added up over partitions and rows of one subtree together give the same trees."""
    rows = labelled(spark, 500).selectExpr("array(a, b, c, d) AS x", "cast(label AS double) AS _label", "1.0D AS weight").rdd.map(
        lambda r: (Vectors.dense(r.x), r._label, r.weight)).toDF(["_features", "_label", "weight"]).coalesce(2)
    estimator = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="weight", numTrees=4, maxDepth=6, minInstancesPerNode=3, seed=3)
    whole = G.fit_forest(rows, estimator, 3)
    monkeypatch.setattr(G, "LOCAL_ROWS", 60)
    assert G.fit_forest(rows, estimator, 3).toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]
    hits = lambda m: m.transform(rows).where("prediction = _label").count()
    assert whole.totalNumNodes > 40 and abs(hits(whole) - hits(estimator.fit(rows))) < 40
    assert whole.getMaxDepth() == 6 and whole.getNumTrees == 4


def test_one_class_is_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(G, "TABLE_MB", 0)
    rows = labelled(spark, 60).where("label = '1'")
    model = I.train_identifier(rows, rows, list("abcd"), trees=3, depth=4)
    assert forest_of(model).totalNumNodes == 3
    assert {r[0] for r in I.score_events(model, rows, []).collect()} == {"1"}

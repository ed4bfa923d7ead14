"""Forests that the driver does not hold: the same votes, importances and files as Spark's model of the same nodes."""

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from alertloom.operators import forest as G, identifier as I
from alertloom.sources import tables
from test_forest import forest_of, labelled


def test_large_forests_stay_written(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(G, "TABLE_MB", 0)
    monkeypatch.setattr(G, "HELD_NODES", 100)
    monkeypatch.setattr(G, "CHUNK_MB", 0.005)
    monkeypatch.setattr(G, "GROUP_ROWS", 150)
    rows = labelled(spark, 400)
    loaded, real = [], RandomForestClassificationModel.load
    monkeypatch.setattr(RandomForestClassificationModel, "load", lambda path: (loaded.append(path), real(path))[1])
    model = I.train_identifier(rows, rows, list("abcd"), trees=7, depth=8, min_leaf=2)
    scored = {tuple(r) for r in I.score_events(model, rows, ["a", "b"]).collect()}
    weights = [tuple(r) for r in I.importances(model).collect()]
    tables.save_model(model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    assert {tuple(r) for r in I.score_events(again, rows, ["a", "b"]).collect()} == scored
    forest = forest_of(model)
    assert not loaded and forest.totalNumNodes > 100 and forest.facts["mb"] > 2 * G.CHUNK_MB

    ready = model.stages[0].transform(rows)
    spark_model = forest.in_driver()
    own, other = ({r.a: (r._prediction, r._raw.toArray(), r._probability.toArray()) for r in m.transform(ready).collect()}
                  for m in (forest, spark_model._set(predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw")))
    assert len(own) == len(other) == 400
    for a in own:
        assert own[a][0] == other[a][0] and abs(own[a][1] - other[a][1]).max() < 1e-9 and abs(own[a][2] - other[a][2]).max() < 1e-9
    assert spark_model.totalNumNodes == forest.totalNumNodes
    assert abs(forest.featureImportances.toArray() - spark_model.featureImportances.toArray()).max() < 1e-9
    assert [w[0] for w in weights] == [n for _, n in sorted(zip(-spark_model.featureImportances.toArray(), "abcd"))]


def test_written_forest_of_no_rows_and_one_class(spark, monkeypatch):
    monkeypatch.setattr(G, "TABLE_MB", 0)
    monkeypatch.setattr(G, "HELD_NODES", 0)
    rows = labelled(spark, 60).where("label = '1'")
    model = I.train_identifier(rows, rows, list("abcd"), trees=3, depth=4)
    assert {r[0] for r in I.score_events(model, rows, []).collect()} == {"1"}
    assert I.score_events(model, rows.where("a > 2"), ["a"]).count() == 0
    assert I.importances(model).agg(F.sum("importance")).first()[0] == 0

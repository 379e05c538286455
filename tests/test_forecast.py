"""Boosted trees, bags, early stops, importance and stored models on small tables."""

import random

from pyspark.sql import functions as F

from gridloom.operators import evaluation as ev
from gridloom.operators import forecast as fc


def rows_of(spark, n, seed):
    r = random.Random(seed)
    rows = [(k, r.gauss(0, 1) if k % 9 else None, r.gauss(0, 1)) for k in range(n)]
    rows = [(k, x, y, (x or 0.0) * 2 + r.gauss(0, 0.01)) for k, x, y in rows]
    return spark.createDataFrame(rows, "id long, x double, y double, target double")


def test_trees_learn_stop_and_are_stored(spark, tmp_path):
    fit, val = rows_of(spark, 400, 1), rows_of(spark, 100, 2)
    options = {"maxIter": 8, "maxDepth": 3}
    out, model = fc.fit_predict(fit, val, ["x", "y"], **options)
    mae = lambda df: df.agg(*ev.metrics("target", "prediction")).first().mae
    assert mae(out) < 0.6 and out.count() == 100
    stopped = fc.fit_predict(fit.withColumn("stop", F.col("id") % 5 == 0), val, ["x", "y"], stop_column="stop", **options | {"maxIter": 30, "validationTol": 0.5})[1]
    assert stopped.getNumTrees < 30
    filled = ev.median_impute(fit, val, "x", "y")
    predict = lambda df: model.transform(fc.assembled(df, ["x", "y"])).drop("features")
    gains = {r.feature: r.importance for r in fc.permutation_importance(predict, filled, ["x", "y"], ["id"], repeats=2).collect()}
    assert gains["x"] > 0.5 > gains["y"]
    table = spark.createDataFrame(list(gains.items()), "feature string, importance double")
    assert [r.feature for r in fc.prune_list(table, 0.4).collect()] == ["y"]
    fc.save_model(model, f"{tmp_path}/model")
    again = fc.load_model(f"{tmp_path}/model").transform(fc.assembled(filled, ["x", "y"]))
    assert abs(mae(again) - mae(out)) < 1e-9

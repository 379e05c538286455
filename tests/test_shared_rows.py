"""Rows that are in many models are stored once, and give the trees that a copy a model gives."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import boosting as bo

from .test_boosting import S, table


def test_a_row_of_many_models_is_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "KEEP", 1)
    monkeypatch.setattr(bo, "PACK", 16)
    once = table(spark, 120, 4).drop("model")
    own = F.when(F.col("id") % 3 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    held = F.when(F.col("id") % 3 == 0, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.col("stop")))
    shared = once.withColumns({"model": own, "flags": held})
    pair = F.explode(F.arrays_zip(F.col("model").alias("m"), F.col("flags").alias("s")))
    apart = shared.withColumn("_p", pair).select("id", "x", "y", "z", "target", F.col("_p.m").alias("model"), F.col("_p.s").alias("flags"))
    names, settings = ["x", "y", "z"], {0: S(iterations=2, rate=0.5, depth=2, leaves=4, min_rows=5), 1: S(iterations=2, rate=0.5, depth=2, leaves=4, min_rows=5, loss="l1", patience=2)}
    a = bo.fit_boosted(shared, names, "target", settings, f"{tmp_path}/a", stop="flags", bins=12)
    b = bo.fit_boosted(apart, names, "target", settings, f"{tmp_path}/b", stop="flags", bins=12)
    assert all(np.array_equal(u, v) for u, v in zip(a.cuts, b.cuts, strict=True))
    for m in (0, 1):
        assert len(a.trees[m]) == len(b.trees[m]) > 0 and np.allclose(a.errors[m], b.errors[m])
        assert all(np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.allclose(s.value, t.value) for s, t in zip(a.trees[m], b.trees[m], strict=True))
    stored = lambda at: sum(len(r.y) // 8 for r in spark.read.parquet(f"{tmp_path}/{at}/state-0").select("y").collect())
    assert stored("a") == 120 and stored("b") == 200
    got = a.predict(shared, keep=["id"]).orderBy("id").collect()
    alone = {m: {r.id: r.prediction for r in b.predict(once, m).collect()} for m in (0, 1)}
    assert all(len(r.prediction) == (1 if r.id % 3 == 0 else 2) and abs(r.prediction[-1] - alone[len(r.prediction) - 1][r.id]) < 1e-9 for r in got) and "x" not in got[0].asDict()


def test_cuts_count_rows_by_weight(spark, monkeypatch):
    monkeypatch.setattr(bo, "SKETCH_ROWS", 50)
    df = spark.range(400).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 100, 7).otherwise(1).alias("n"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.0).alias("flat"))
    (cuts, flat), every = bo.sketched_cuts(df, ["x", "flat"], 4, "n"), np.repeat(np.arange(400.0), np.where(np.arange(400) < 100, 7, 1))
    assert flat.tolist() == [1.0] and np.abs(np.searchsorted(every, cuts) - len(every) * np.arange(1, 4) / 4).max() <= len(every) / 40

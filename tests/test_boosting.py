"""Trees from added-up histograms against brute force, and many models at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting as bo

S = bo.Settings


def table(spark, n, seed, models=(0,)):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, z = r.gauss(0, 1), r.gauss(0, 1), r.choice([None, 1.0, 2.0])
        t = 3 * (x > 0.3) + (5 if z is None else z) + 0.1 * y + r.gauss(0, 0.05)
        rows += [(m, k, k % 7 == 0, x if k % 11 else None, y if k % 13 else float("nan"), z, t) for m in models]
    return spark.createDataFrame(rows, "model int, id long, stop boolean, x double, y double, z double, target double")


def brute_split(codes, g, l2, min_rows):
    """(gain, feature, bin, missing) of the best split of some rows."""
    best = None
    for f in range(codes.shape[1]):
        for b in sorted(set(codes[:, f]) - {0}):
            for missing in (False, True):
                left = np.where(codes[:, f] == 0, missing, codes[:, f] <= b)
                nl, nr, gl, gr = left.sum(), (~left).sum(), g[left].sum(), g[~left].sum()
                if nl >= min_rows and nr >= min_rows:
                    gain = gl**2 / (nl + l2) + gr**2 / (nr + l2) - g.sum() ** 2 / (len(g) + l2)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, b, missing)
    return best


@pytest.mark.parametrize("loss", ["l2", "l1"])
def test_first_tree_equals_brute_force(spark, tmp_path, loss):
    rows, names = table(spark, 300, 1), ["x", "y", "z"]
    s = S(iterations=1, rate=0.5, depth=3, leaves=6, min_rows=8, l2=1.0, loss=loss)
    fitted = bo.fit_boosted(rows, names, "target", {0: s}, f"{tmp_path}/b", stop="stop", bins=16)
    data = rows.where("NOT stop").toPandas()
    codes = np.stack([np.where(np.isnan(data[c].astype(float)), 0, np.searchsorted(at, data[c].astype(float), "left") + 1) for c, at in zip(names, fitted.cuts, strict=True)], axis=1)
    base = data.target.mean() if loss == "l2" else fitted.base[0]
    assert abs(base - fitted.base[0]) < 1e-9 and abs(base - (data.target.mean() if loss == "l2" else data.target.median())) < 0.1
    rest = data.target.to_numpy() - fitted.base[0]
    g = rest if loss == "l2" else np.sign(rest)
    open_, done, splits = [(np.arange(len(g)), 0)], [], 0
    while open_ and splits < s.leaves - 1:  # the best leaf first
        found = [(brute_split(codes[i], g[i], s.l2, s.min_rows) if d < s.depth else None, i, d) for i, d in open_]
        found = [f for f in found if f[0]]
        if not found:
            break
        (_, f, b, missing), i, d = max(found, key=lambda x: x[0][0])
        left = np.where(codes[i, f] == 0, missing, codes[i, f] <= b)
        open_ = [(j, e) for j, e in open_ if not np.array_equal(j, i)] + [(i[left], d + 1), (i[~left], d + 1)]
        splits += 1
    tree = fitted.trees[0][0]
    leaf = tree.leaves(codes)
    groups = {tuple(np.flatnonzero(leaf == k)) for k in set(leaf)}
    assert groups == {tuple(sorted(i)) for i, _ in open_} and len(groups) == splits + 1 > 3
    for k in set(leaf):
        mine = rest[leaf == k]
        assert abs(tree.value[k] - 0.5 * (mine.sum() / (len(mine) + 1) if loss == "l2" else np.sort(mine)[(len(mine) - 1) // 2])) < 1e-6, (k, len(mine))


def test_many_models_are_fitted_by_as_many_jobs_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "KEEP", 2)
    count = [0]
    whole = bo.best_splits

    def counted(*args):
        count[0] += 1
        return whole(*args)

    monkeypatch.setattr(bo, "best_splits", counted)
    names, base = ["x", "y", "z"], {"iterations": 5, "rate": 0.4, "depth": 3, "leaves": 8, "min_rows": 5}
    one = bo.fit_boosted(table(spark, 250, 2), names, "target", {0: S(**base)}, f"{tmp_path}/one", stop="stop", bins=12)
    jobs, count[0] = count[0], 0
    settings = {0: S(**base), 1: S(**base, features=("x",)), 2: S(**base | {"loss": "l1"}), 3: S(**base | {"rate": 0.1, "depth": 1}), 9: S()}
    many = bo.fit_boosted(table(spark, 250, 2, (0, 1, 2, 3)), names, "target", settings, f"{tmp_path}/many", stop="stop", bins=12, cuts=one.cuts)
    assert count[0] == jobs and sorted(many.trees) == [0, 1, 2, 3]
    rows = table(spark, 80, 3, (0, 1, 2, 3, 9))
    got = {(r.model, r.id): r.prediction for r in many.predict(rows).collect()}
    alone = {r.id: r.prediction for r in one.predict(table(spark, 80, 3), 0).collect()}
    assert all(abs(alone[k] - got[0, k]) < 1e-9 for k in alone) and all(got[9, k] is None for k in alone)
    mae = {r.model: r.e for r in many.predict(rows).groupBy("model").agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e")).collect()}
    assert mae[0] < 0.6 and mae[2] < 0.6 < mae[1] and mae[3] > mae[0]
    assert all({k for t in many.trees[1] for k in t.feature.tolist()} <= {-1, 0} for _ in [0]) and all(s > 0 for s in many.seconds.values())
    bo.save_boosted(many, spark, f"{tmp_path}/saved")
    again = bo.load_boosted(spark, f"{tmp_path}/saved")
    assert again.settings == {m: settings[m] for m in many.trees}
    assert {(r.model, r.id): r.prediction for r in again.predict(rows).collect()} == got


def test_training_stops_on_rows_held_back(spark, tmp_path):
    r = random.Random(5)
    rows = [(0, k, k % 3 == 0, r.gauss(0, 1), r.gauss(0, 1)) for k in range(240)]  # nothing to learn
    df = spark.createDataFrame(rows, "model int, id long, stop boolean, x double, target double")
    s = S(iterations=30, rate=0.5, depth=2, leaves=4, min_rows=5, patience=3)
    fitted = bo.fit_boosted(df, ["x"], "target", {0: s}, f"{tmp_path}/b", stop="stop", bins=32)
    errors = fitted.errors[0]
    assert len(errors) < 20 and len(fitted.trees[0]) == int(np.argmin(errors)) and len(errors) - 1 - int(np.argmin(errors)) == 3
    held = fitted.predict(df.where("stop"), 0).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    assert abs(held - min(errors)) < 1e-9


def test_odd_tables(spark, tmp_path):
    df = table(spark, 60, 6)
    none = bo.fit_boosted(df.where("false"), ["x"], "target", {0: S(iterations=2)}, f"{tmp_path}/none")
    assert none.trees == {} and {r.prediction for r in none.predict(df).collect()} == {None}
    flat = bo.fit_boosted(df.withColumn("target", F.lit(7.0)).withColumn("n", F.lit(None).cast("double")), ["x", "n"], "target", {0: S(iterations=3, min_rows=2)}, f"{tmp_path}/flat")
    assert flat.trees[0] == [] and {r.prediction for r in flat.predict(df.withColumn("n", F.lit(1.0))).collect()} == {7.0}
    with pytest.raises(ValueError):
        bo.fit_boosted(df, ["x"], "target", {0: S()}, f"{tmp_path}/x", bins=300)

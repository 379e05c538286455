"""The search trains whole settings, and what lets deep trees and many of them be grown."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting as bo
from gridloom.plans import catalog, experiments

from .test_boosting import S, brute_split, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_the_search_trains_whole_settings(spark, monkeypatch):
    class Stop(Exception):
        pass

    def seen(rows, features, target, settings, *_, **__):
        raise Stop(settings)

    monkeypatch.setattr(experiments, "drawn_features", lambda spark, d, *_: (catalog.panel(spark, d).withColumn("draw", F.lit(0)), ["value"]))
    monkeypatch.setattr(bo, "fit_boosted", seen)
    with pytest.raises(Stop) as found:
        catalog.queries()["hyperparameter_grid"](spark, SF)
    whole = [bo.Settings(it, rate, depth, 31, rows, l2) for rate, it, depth, rows, l2 in experiments.GRID.values()]
    assert found.value.args[0] == {k: s for k, s in enumerate(whole * experiments.FOLDS)}


def test_deep_trees_sum_only_nodes_that_can_be_split(spark, tmp_path, monkeypatch):
    rows, names, live, best = table(spark, 300, 1), ["x", "y", "z"], [], bo.best_splits

    def counted(sums, plan, parts):
        live.append(len(plan[0].live))
        return best(sums, plan, parts)

    monkeypatch.setattr(bo, "best_splits", counted)
    s = S(iterations=1, rate=0.5, depth=12, leaves=8, min_rows=2, l2=0.0)
    fitted = bo.fit_boosted(rows, names, "target", {0: s}, f"{tmp_path}/b", bins=8)
    assert max(live) <= 2 * (s.leaves - 2) and len(live) > 4
    data = rows.toPandas()
    codes = np.stack([np.where(np.isnan(data[c].astype(float)), 0, np.searchsorted(at, data[c].astype(float), "left") + 1) for c, at in zip(names, fitted.cuts, strict=True)], axis=1)
    g, open_ = data.target.to_numpy() - fitted.base[0], [np.arange(len(data))]
    while len(open_) < s.leaves:  # the best leaf first, whatever its depth
        (_, f, b, missing), i = max(((found, i) for i in open_ if (found := brute_split(codes[i], g[i], s.l2, s.min_rows))), key=lambda x: x[0][0])
        left = np.where(codes[i, f] == 0, missing, codes[i, f] <= b)
        open_ = [j for j in open_ if j is not i] + [i[left], i[~left]]
    leaf = fitted.trees[0][0].leaves(codes)
    assert {tuple(np.flatnonzero(leaf == k)) for k in set(leaf)} == {tuple(sorted(i)) for i in open_}


def test_models_go_at_their_own_pace(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "KEEP", 1)
    count, best = [0], bo.best_splits

    def counted(*args):
        count[0] += 1
        return best(*args)

    monkeypatch.setattr(bo, "best_splits", counted)
    settings = {0: S(iterations=2, rate=0.3, depth=5, leaves=31, min_rows=2), 1: S(iterations=5, rate=0.3, depth=2, leaves=4, min_rows=2, loss="l1"), 2: S(iterations=4, rate=0.3, depth=1, min_rows=2, loss="l1")}
    names = ["x", "y", "z"]
    many = bo.fit_boosted(table(spark, 200, 2, (0, 1, 2)), names, "target", settings, f"{tmp_path}/many", bins=16)
    assert count[0] == 11 and [len(many.trees[m]) for m in settings] == [2, 5, 4]  # the deepest ones of each turn would be 10 + 6 + 1
    stored = sorted(x for x in os.listdir(f"{tmp_path}/many") if x.startswith("state"))
    assert len(stored) == 2 and stored[0] == "state-0"
    for m, s in settings.items():
        alone = bo.fit_boosted(table(spark, 200, 2), names, "target", {0: s}, f"{tmp_path}/{m}", bins=16, cuts=many.cuts)
        for a, b in zip(alone.trees[0], many.trees[m], strict=True):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value)


def test_ties_but_for_rounding_go_to_the_first_feature():
    g = np.array([[[0.0, 0.3, -5.0, 4.7], [0.0, 0.3, -5.0000000000001, 4.7000000000001]]])
    n = np.array([[[0, 9, 9, 9]] * 2])
    gains = [bo._best(g[:, [k]], n[:, [k]], np.array([k]), 1.0, 2)[0][0] for k in range(2)]
    for order in ([0, 1], [1, 0]):
        best = bo._best(g[:, order], n[:, order], np.array([4, 7]), 1.0, 2)[0]
        assert best[:4] == (pytest.approx(max(gains), rel=1e-12), 4, 2, False) and best[5] == 18 and best[7] == 9
    assert gains[0] < gains[1] and bo._best(g, n, np.arange(2), 1.0, 14) == [None]

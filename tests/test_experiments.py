"""Each experiment with fitted members, through its query, on the smallest tables."""

import os
from dataclasses import replace

import pytest

from gridloom.plans import catalog, experiments

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(autouse=True)
def short(monkeypatch):
    monkeypatch.setattr(experiments, "QUICK", replace(experiments.QUICK, iterations=2, depth=2, leaves=4))


def rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_baselines_under_both_schemes(spark):
    got = {(r.scheme, r.model, r.fold): r for r in rows(spark, "fitted_by_scheme")}
    models = {"persistence", "climatology", "boosted", "boosted_absolute"}
    assert {k[1] for k in got} == models and {k[0] for k in got} == {"temporal", "spatial"}
    n = {(s, m): sum(r.n for k, r in got.items() if k[:2] == (s, m)) for s in ("temporal", "spatial") for m in models}
    assert n["temporal", "boosted"] == n["temporal", "boosted_absolute"] >= n["temporal", "climatology"] and n["spatial", "boosted"] > n["temporal", "boosted"]
    mean = lambda s, m: sum(r.mae * r.n for k, r in got.items() if k[:2] == (s, m)) / n[s, m]
    assert all(mean(s, "boosted") < mean(s, "persistence") for s in ("temporal", "spatial"))


def test_bags(spark):
    assert {r.scheme for r in rows(spark, "bagged_by_scheme")} == {"temporal", "spatial"}
    assert {r.members for r in rows(spark, "bagged_predictions")} == {len(catalog.MEMBERS)}
    assert {r.kind for r in rows(spark, "neighbours_fitted")} == {"with", "without"}
    ranges = rows(spark, "rate_ranges_fitted")
    assert len(ranges) == len(experiments.RANGES) and all(r.mae_mean > 0 for r in ranges)


def test_members_by_horizon_and_number(spark, monkeypatch):
    got = rows(spark, "member_by_horizon_fitted")
    assert sorted(r.member for r in got) == list(range(len(catalog.MEMBERS))) and len({r.n_hidden for r in got}) == 1 and all(r.mae_seen > 0 for r in got)
    monkeypatch.setattr(experiments, "CURVE", (42, 43, 44))
    curve = sorted(rows(spark, "member_curve"))
    assert [r.n_models for r in curve] == [1, 2, 3] and curve[0].seconds < curve[1].seconds < curve[2].seconds


def test_searches_and_importance(spark):
    assert {r.setting for r in rows(spark, "hyperparameter_grid")} == set(experiments.GRID)
    assert experiments.grid_settings()["slow"] == experiments.bo.Settings(500, 0.03, 8, 31, 50, 1.0)
    found = {r.feature: r.importance for r in rows(spark, "permutation_importance")}
    assert {"value", "north_last_observed", "value_diff12_trend_mean", "target_month_sin"} <= set(found) and len(found) > 35


def test_forecasts(spark):
    assert all(r.prediction is not None for r in rows(spark, "early_stopped_forecast"))
    got = {r.model: r for r in rows(spark, "starter_baseline")}
    assert set(got) == {"persistence", "trees", "trees_with_position"} and got["persistence"].mae_gain is None and got["trees"].mae_gain < 0
    final = rows(spark, "final_predictions_fitted")
    template = catalog.panel(spark, SF).where("NOT is_train").count()
    assert len(final) == template and all(r.Target[-3] == "." for r in final)


def test_a_row_carries_the_number_of_its_parts(spark):
    from pyspark.sql import functions as F

    table = catalog.panel(spark, SF).withColumn("draw", F.lit(0))
    rows, sets = experiments.with_roles(table, "temporal", "spatial")
    assert dict(rows.dtypes)["part"] == "int" and sets.count() < 200
    told = {r.part: {tuple(p) for p in r.parts} for r in sets.collect()}
    wanted: dict = {}
    for scheme, (tell, key, roles) in experiments.ROLES.items():
        apart = experiments._known(table).withColumn("_k", tell()).join(roles(table).withColumnRenamed(key, "_r"), F.col("_k") == F.col("_r"))
        for r in apart.select("lat", "lon", "time", "fold", "role", "stop").collect():
            wanted.setdefault((r.lat, r.lon, r.time), set()).add((scheme, r.fold, r.role, r.stop))
    assert {(r.lat, r.lon, r.time): told[r.part] for r in rows.collect()} == wanted
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "transform" not in plan

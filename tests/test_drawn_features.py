"""Features of many draws at once, neighbours' included, against those of the panel repeated a draw."""

import numpy as np
import pytest

from gridloom.operators import outages as ou
from gridloom.operators import redraw as rd
from gridloom.operators.panel import PANEL
from gridloom.plans import catalog
from gridloom.plans.features import build_features

from .test_neighbours import holed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gapped", [False, True])
def test_draws_equal_those_of_a_repeated_panel(spark, tmp_path, monkeypatch, gapped):
    catalog.panel(spark, SF).write.parquet(f"{tmp_path}/panel")
    rows = spark.read.parquet(f"{tmp_path}/panel")
    months = ou.train_months(rows)
    if gapped:
        rows = ou.mask_months(rows, months[5:9])
    gaps = {k: ou.draw_months(months, ou.scaled(catalog.RATES, f), np.random.default_rng(k)) for k, f in enumerate((0.0, 1.0, 2.0))}
    wanted = build_features(*ou.many_draws(rows, gaps))
    monkeypatch.setattr(rd, "TASK_ROWS", 500)
    made = rd.drawn_features(rows, gaps)
    got = made.select(*wanted.columns)
    assert set(made.columns) == set(wanted.columns) and got.dtypes == wanted.dtypes
    assert got.count() == 3 * rows.count() and got.exceptAll(wanted).count() == 0 == wanted.exceptAll(got).count()
    assert made.rdd.getNumPartitions() == -(-3 * rows.count() // 500)  # as many tasks as all draws' rows need
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate posexplode")]  # draws' rows are never exchanged


def test_draws_of_odd_panels(spark):
    df = holed(spark, 24)[0]
    df = df if "is_train" in df.columns else df.selectExpr("*", "true AS is_train")
    gaps = {0: set(), 1: {r.time for r in df.select("time").distinct().orderBy("time").limit(4).collect()}}
    wanted = build_features(*ou.many_draws(df, gaps))
    for some in (df, df.where("false")):
        got = rd.drawn_features(some, gaps).select(*wanted.columns)
        other = build_features(*ou.many_draws(some, gaps))
        assert got.exceptAll(other).count() == 0 == other.exceptAll(got).count()
    assert PANEL.keys == ("lat", "lon")

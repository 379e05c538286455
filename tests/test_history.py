import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import history as hi
from gridloom.operators.outages import mask_months
from gridloom.operators.panel import PANEL, broken_rules, no_nan, split_panel, union_panels

SCHEMA = "lat double, lon double, time date, value double, masked boolean"


def months(first, n):
    y, m = first
    return [dt.date(y + (m - 1 + k) // 12, (m - 1 + k) % 12 + 1, 1) for k in range(n)]


def panel(spark, cells, first=(2020, 1), skip=()):
    rows = []
    for (lat, lon), values in cells.items():
        for t, v in zip([t for t in months(first, 99) if t not in skip], values):
            v, m = v if isinstance(v, tuple) else (v, v is None)
            rows.append((lat, lon, t, v, m))
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name, cell=(0.5, 0.5)):
    return [r[0] for r in df.where((F.col("lat") == cell[0]) & (F.col("lon") == cell[1])).orderBy("time").select(name).collect()]


def drawn_panel(spark, seed, cells=7, steps=40):
    """A panel of random values and holes, and its cells' (time, value) in order, to be walked by plain loops."""
    r = random.Random(seed)
    series = {(17.0 - c, 3.25 * c): [(t, None if r.random() < 0.25 else r.randrange(-900, 900) / 4) for t in months((1991, 4), steps) if r.random() < 0.9] for c in range(cells)}
    rows = [(*cell, t, v, v is None) for cell, steps_ in series.items() for t, v in steps_]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), series


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def test_features_equal_plain_loops(spark):
    df, series = drawn_panel(spark, 5)
    df = df.withColumns(hi.lags("value", (1, 3, 12)) | hi.rolling_means("value", (3, 6)) | hi.climatology()).withColumns(hi.differences("value", (1, 12)))
    df = df.withColumns(hi.trend(("value_diff1", "value_diff12")))
    for cell, steps in series.items():
        values = [v for _, v in steps]
        lag = lambda k: [values[i - k] if i >= k else None for i in range(len(values))]  # noqa: B023, E731
        less = lambda k: [None if v is None or w is None else v - w for v, w in zip(values, lag(k), strict=True)]  # noqa: B023, E731
        for k in (1, 3, 12):
            assert column(df, f"value_lag{k}", cell) == lag(k)
        for n in (3, 6):
            assert column(df, f"value_rollmean{n}", cell) == [mean(values[max(0, i - n + 1) : i + 1]) for i in range(len(values))]
        for k in (1, 12):
            assert column(df, f"value_diff{k}_trend_mean", cell) == pytest.approx([mean(less(k)[:i]) for i in range(len(values))])
            assert column(df, f"value_diff{k}_trend_count", cell) == [sum(x is not None for x in less(k)[:i]) if i else None for i in range(len(values))]
        earlier = [[v for u, v in steps[:i] if u.month == t.month] for i, (t, _) in enumerate(steps)]
        assert column(df, "climatology_mean", cell) == pytest.approx([mean(e) for e in earlier])
        assert column(df, "climatology_count", cell) == [sum(v is not None for v in e) if e else None for e in earlier]


def test_horizon_counts_calendar_months(spark):
    df = panel(spark, {(0.5, 0.5): [0.3, None, None, 0.45, None]}, first=(2015, 8)).withColumns(hi.last_observed())
    assert column(df, "months_since_observed") == [1, 2, 3, 1, 2]
    assert column(df, "last_observed") == [0.3, 0.3, 0.3, 0.45, 0.45]
    gap = panel(spark, {(0.5, 0.5): [0.3, None]}, skip=[dt.date(2020, 2, 1)]).withColumns(hi.last_observed() | hi.lags("value", (1,)))
    assert column(gap, "months_since_observed") == [1, 3] and column(gap, "value_lag1") == [None, 0.3]
    flag = panel(spark, {(0.5, 0.5): [(0.3, False), (None, False)]}).withColumns(hi.last_observed())
    assert column(flag, "months_since_observed") == [1, 1] and column(flag, "last_observed") == [0.3, 0.3]


def test_later_rows_change_nothing_before(spark):
    values = [1.0, 2.0, None, 4.0, 3.0, 7.0, 5.0, 6.0, 9.0, 8.0, 11.0, 10.0, 13.0, 12.0]
    cell = (0.5, 0.5)
    before = hi.add_history(panel(spark, {cell: values}), PANEL).where("time < '2021-01-01'").orderBy("time").collect()
    after = hi.add_history(panel(spark, {cell: [*values[:12], -99.0, 77.0]}), PANEL).where("time < '2021-01-01'").orderBy("time").collect()
    assert before == after


def test_all_windows_share_one_exchange(spark):
    df = hi.add_history(panel(spark, {(0.5, 0.5): [1.0, 2.0]}).repartition(3))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = hi.add_history(panel(spark, {(0.5, 0.5): [1.0, 2.0]}))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and df.count() == 2


def test_masked_runs(spark):
    cells = {(0.5, 0.5): [1.0, None, None, 1.0, None], (1.5, 0.5): [1.0, None, None], (2.5, 0.5): [1.0, 1.0]}
    got = {r.lat: (r.runs, r.cumulative) for r in hi.masked_runs(panel(spark, cells)).collect()}
    assert got == {0.5: (2, False), 1.5: (1, True), 2.5: (0, False)}


def test_panel_union_split_and_rules(spark):
    train = spark.createDataFrame([(0.5, 0.5, dt.date(2020, 1, 1), 1.0, 2.0)], "lat double, lon double, time date, value double, target double")
    test = spark.createDataFrame([(0.5, 0.5, dt.date(2020, 2, 1), None, True)], "lat double, lon double, time date, value double, masked boolean")
    both = union_panels(train, test)
    assert {(r.time.month, r.is_train, r.masked, r.target) for r in both.collect()} == {(1, True, False, 2.0), (2, False, True, None)}
    a, b = split_panel(both)
    assert "target" in a.columns and "target" not in b.columns and a.count() == b.count() == 1
    assert {r.rule: r.rows for r in broken_rules(both).collect()} == {"repeated_step": 0, "flag_and_value": 0, "target_on_test": 0}
    assert {r.rule: r.rows for r in broken_rules(both.union(both)).collect()}["repeated_step"] == 2
    assert mask_months(both, [dt.date(2020, 1, 1)]).where("masked").count() == 2


def test_nan_becomes_null(spark):
    assert no_nan(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")).first().asDict() == {"a": None, "b": 1.0}

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.calendar import climate_zone, latitude_band, season, two_decimals
from gridloom.operators import evaluation as ev
from gridloom.operators import folds as fo
from gridloom.operators import outages as ou
from gridloom.operators.forecast import permuted

from .test_history import months, panel

D = lambda y, m: dt.date(y, m, 1)
RATES = [(2002, 2010, 0.05), (2011, 2014, 0.35), (2015, 2015, 0.5)]


def test_rates_scale_and_cap():
    assert [r for *_, r in ou.scaled(RATES, 2.0)] == pytest.approx([0.1, 0.7, 0.9])
    assert ou.rate_of(2001, RATES) == 0.0


def test_draws_repeat_with_their_seed():
    every = months((2011, 1), 48)
    draw = lambda s: frozenset(ou.draw_months(every, RATES, np.random.default_rng(s)))
    assert draw(1) == draw(1) and len({draw(s) for s in range(10)}) > 1
    assert ou.draw_months(every, [(2000, 2030, 1.0)], np.random.default_rng(0)) == set(every)


def test_masking_spares_test_rows_and_targets(spark):
    import random

    r = random.Random(11)
    rows = [(float(c), 2.5, t, None if r.random() < 0.2 else r.uniform(-50, 50), r.random() < 0.7, r.uniform(0, 9)) for c in range(6) for t in months((1987, 11), 17)]
    rows = [(*k, v, v is None, train, y) for *k, v, train, y in rows]
    df = spark.createDataFrame(rows, "lat double, lon double, time date, value double, masked boolean, is_train boolean, target double")
    gap = {t for t in months((1987, 11), 17) if t.month % 3 == 0}
    got = {(x.lat, x.time): (x.value, x.masked, x.is_train, x.target) for x in ou.mask_months(df, gap).collect()}
    for lat, _, t, v, m, train, y in rows:
        hit = train and t in gap
        assert got[lat, t] == (None if hit else v, m or hit, train, y)


def test_streaks(spark):
    gap = spark.createDataFrame([(D(2011, m),) for m in (1, 2, 5, 7, 8, 9, 10)], "time date")
    assert sorted(r[1] for r in ou.streaks(gap).groupBy("streak").count().collect()) == [1, 2, 4]
    assert {r[0].month for r in ou.capped(gap, 3).collect()} == {1, 2, 5, 7, 8, 9}
    every = spark.createDataFrame([(D(2011, m),) for m in range(1, 13)], "time date")
    two = spark.createDataFrame([(D(2011, m),) for m in (1, 2, 5)], "time date")
    assert {r[0].month for r in ou.extended(two, every, 4).collect()} == {1, 2, 3, 4, 5, 6, 7, 8}
    late = spark.createDataFrame([(D(2011, 12),)], "time date")
    assert {r[0].month for r in ou.extended(late, every, 3).collect()} == {12}
    near = spark.createDataFrame([(D(2011, m),) for m in (1, 3)], "time date")
    assert {r[0].month for r in ou.extended(near, every, 3).collect()} == {1, 3, 4, 5}


def test_temporal_folds_never_look_ahead(spark):
    df = panel(spark, {(0.5, float(c)): [1.0] * 24 for c in range(3)})
    rows = fo.temporal_folds(df, 4).collect()
    sizes = []
    for f in range(4):
        fit, val = ({r.time for r in rows if (r.fold, r.role) == (f, x)} for x in ("fit", "val"))
        assert max(fit) < min(val) and len(val) == 4
        sizes.append(len(fit))
    assert sizes == sorted(set(sizes))


def test_138_months_give_windows_of_23(spark):
    df = panel(spark, {(0.5, 0.5): [1.0] * 99}, first=(2002, 5)).unionByName(panel(spark, {(0.5, 0.5): [1.0] * 39}, first=(2010, 8)))
    val = fo.temporal_folds(df, 5).where("role = 'val'").groupBy("fold").count().collect()
    assert sorted((r[0], r[1]) for r in val) == [(f, 23) for f in range(5)]


def test_blocks_stay_whole(spark):
    df = panel(spark, {(a, b): [1.0, 2.0] for a in (5.0, 25.0, -0.5) for b in (5.0, 6.0, 7.0, 8.0)})
    folds = fo.spatial_folds(df, 2).collect()
    assert len({r.block for r in folds}) == len(folds) == 3 and {r.fold for r in folds} == {0, 1} and any(r.block == "-1_0" for r in folds)
    roles = [r.role for r in fo.spatial_holdout(df, 0.5).collect()]
    assert sorted(roles) == ["fit", "fit", "val"]
    hold = fo.temporal_holdout(df, 0.5).collect()
    assert max(r.time for r in hold if r.role == "fit") < min(r.time for r in hold if r.role == "val")
    assert [r.role for r in fo.two_tier_split(panel(spark, {(0.5, 0.5): [1.0] * 20})).orderBy("time").collect()].count("inner_val") == 3


def test_metrics(spark):
    of = lambda rows: spark.createDataFrame(rows, "y double, p double").agg(*ev.metrics("y", "p")).first()
    assert tuple(of([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]))[1:] == (0, 0, 1)
    assert of([(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (None, 9.0)]).mae == 2
    per = spark.createDataFrame([("m", 1.0, 1.0, 0.0), ("m", 3.0, 3.0, 0.0)], "model string, mae double, rmse double, r2 double")
    assert ev.fold_summary(per, "model").first().mae_std == 1.0


def test_ensembles(spark):
    members = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0), ("b", 1, 5.0)], "id string, member int, prediction double")
    assert {r.id: r.prediction for r in ev.ensemble_mean(members, "id").collect()} == {"a": 2.0, "b": 5.0}
    assert {(r.id, r.n_models): r.prediction for r in ev.ensemble_curve(members, "id").collect()}["a", 2] == 2.0
    curve = spark.createDataFrame([(1, 10.0), (2, 9.05), (3, 9.0), (4, 9.2)], "n_models int, mae double")
    assert tuple(ev.best_member_count(curve).first()) == (3, 2)


def test_bins_and_seasons(spark):
    df = spark.createDataFrame([(0.0, D(2020, 1)), (23.5, D(2020, 4)), (-66.6, D(2020, 7)), (91.0, D(2020, 10))], "lat double, time date")
    rows = df.select(climate_zone("lat"), latitude_band("lat"), season("time", "lat")).collect()
    assert [r[0] for r in rows] == ["tropical", "tropical", "polar", None]
    assert [r[1] for r in rows] == ["(-10, 10]", "(10, 30]", "(-70, -50]", None]
    assert [r[2] for r in rows] == ["winter", "spring", "winter", "autumn"]


def test_levels_medians_scaling_histogram(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 11)] + [(None,)], "x double")
    assert [r[0] for r in ev.value_level(df, "x").where("x IS NOT NULL").orderBy("x").select("level").collect()] == [v for v in ev.LEVELS for _ in (0, 1)]
    assert ev.median_impute(df, df, "x").where("x = 5.5").count() == 1
    assert abs(ev.standardise(df, df, "x").agg(F.stddev_pop("x")).first()[0] - 1) < 1e-9
    assert sum(r.n for r in ev.histogram(df, "x", 4).collect()) == 10


def test_template_join_wants_unique_keys_and_predictions(spark):
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    p = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "id string, prediction double")
    assert {r.id: r.prediction for r in ev.template_join(t, p, "id").collect()} == {"a": 2.0, "b": 1.0}
    for template, predictions in ((t, p.union(p)), (t.union(t), p), (t, p.where("id <> 'a'")), (t, p.withColumn("prediction", F.when(F.col("id") == "b", 1.0)))):
        with pytest.raises(Exception, match="repeated|no prediction"):
            ev.template_join(template, predictions, "id").collect()


def test_permutation_keeps_the_values(spark):
    df = spark.range(200).withColumn("x", F.col("id") * 2)
    import hashlib

    out = {r.id: r.x for r in permuted(df.repartition(3), ["x"], ["id"], seed=1, parts=4).collect()}
    order = lambda s: sorted(range(200), key=lambda k: hashlib.md5(f"{s}|{k}".encode()).hexdigest())
    assert out == {a: 2 * b for a, b in zip(order(1), order(2), strict=True)}
    twice = df.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    both = permuted(twice, ["x"], ["id"], seed=1, by=("r",)).collect()
    assert all(sorted(r.x for r in both if r.r == k) == sorted(out.values()) for k in (0, 1)) and {r.id: r.x for r in both if r.r == 0} != {r.id: r.x for r in both if r.r == 1}


def test_two_decimals(spark):
    import random

    r = random.Random(1)
    xs = [0.125, -3.0, 2.345678, 0.165, 0.145, 1.005, 2.675, -0.165, -0.001, 0.995, 0.999, 1e15 + 0.5, 0.0, None]
    xs += [r.uniform(-5, 5) for _ in range(2000)] + [r.randrange(100000) / 1000 for _ in range(2000)] + [r.randrange(-4000, 4000) / 8 for _ in range(500)]
    got = [v[0] for v in spark.createDataFrame([(x,) for x in xs], "x double").select(two_decimals("x")).collect()]
    assert got == [None if x is None else "%.2f" % x for x in xs]
    for x in (float("nan"), float("inf"), float("-inf"), 2.0**53):
        with pytest.raises(Exception, match="no number of two decimals"):
            spark.createDataFrame([(x,)], "x double").select(two_decimals("x")).collect()


def test_metrics_of_a_constant_target(spark):
    r2 = lambda rows: spark.createDataFrame(rows, "t double, p double").agg(*ev.metrics("t", "p")).first().r2
    assert r2([(1.0, 1.0), (1.0, 1.0)]) == 1.0 and r2([(1.0, 2.0), (1.0, 1.0)]) == 0.0


def test_gains_and_stops(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 1.5, 3.0)], "model string, mae double, r2 double")
    assert [tuple(r) for r in ev.metric_gains(df, "model", "a").collect()] == [("b", -0.5, 2.0)]
    assert ev.smoothed_stop([5, 4, 3, 3, 9, 9, 9, 9], patience=2) == 3 and ev.smoothed_stop([], 2) == -1


def test_draws_and_holdouts_are_seeded(spark):
    import numpy as np

    assert ou.multipliers(0.5, 2.0, 4) == [0.5, 1.0, 1.5, 2.0]
    months = [dt.date(2000, m, 1) for m in (1, 5, 9)]
    assert ou.drawn_lengths(months, (4, 5), np.random.default_rng(1)) == ou.drawn_lengths(reversed(months), (4, 5), np.random.default_rng(1))
    df = spark.createDataFrame([(float(10 * k), 0.5) for k in range(10)], "lat double, lon double")
    roles = {r.block: r.role for r in fo.spatial_holdout(df, 0.3).collect()}
    assert sum(v == "val" for v in roles.values()) == 3 and roles == {r.block: r.role for r in fo.spatial_holdout(df, 0.3).collect()}
    assert fo.spatial_holdout(df.where("false"), 0.3).count() == 0


def test_sinks(spark, tmp_path):
    from gridloom.sources import tables as src

    rows = spark.createDataFrame([(2, "b", 0.165), (1, "a", 1.0)], "place int, ID string, Target double")
    src.write_predictions(rows, f"{tmp_path}/p.csv")
    assert (tmp_path / "p.csv").read_bytes() == b"ID,Target\na,1.00\nb,0.17\n"
    src.write_features(rows, f"{tmp_path}/f", ["place", "Target"])
    assert [r.name for r in spark.read.json(f"{tmp_path}/f/manifest.json").orderBy("place").collect()] == ["place", "Target"] and spark.read.parquet(f"{tmp_path}/f/features.parquet").count() == 2
    made = []
    make = lambda n: lambda: made.append(n) or rows.limit(n).select("ID", "Target")
    ids = rows.select("ID")
    for n in (1, 2, 2):  # the cache of one id is stale
        got = src.member_predictions(spark, f"{tmp_path}/m", 1, 0.5, make(n), ids)
    assert made == [1, 2] and got.count() == 2
    src.append_run(rows, f"{tmp_path}/r", "x")
    src.append_run(rows, f"{tmp_path}/r", "y")
    assert not src.append_run(rows, f"{tmp_path}/r", "y") and src.append_run(rows.limit(1), f"{tmp_path}/r", "x")
    assert {r.run: r["count"] for r in spark.read.parquet(f"{tmp_path}/r").groupBy("run").count().collect()} == {"x": 1, "y": 2}
    src.write_report(rows, f"{tmp_path}/report", "place")
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1
    (tmp_path / "file").write_text("lags: [1, 3]\n")
    assert src.read_settings(f"{tmp_path}/file") == {"lags": [1, 3]}
    assert src.write_if_possible(rows, f"{tmp_path}/oof") is None and src.write_if_possible(rows, f"{tmp_path}/file/x") is not None


def test_percentiles_equal_sorting(spark):
    import random

    r = random.Random(8)
    rows = [(r.gauss(0, 9), float(r.randrange(4)) if i % 3 else None, None, 7.0 if i % 2 else r.random()) for i in range(501)]
    df = spark.createDataFrame(rows, "many double, few double, none double, hot double").repartition(5)
    ps = [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    got = ev.percentiles(df, {c: ps for c in df.columns}, parts=20).first()
    for k, c in enumerate(df.columns):
        values = sorted(x[k] for x in rows if x[k] is not None)
        if not values:
            assert got[c] is None
            continue
        for p, x in zip(ps, got[c], strict=True):
            at = p * (len(values) - 1)
            a, b = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert abs(x - (a + (b - a) * (at - int(at)))) < 1e-9
    assert ev.percentiles(df.where("false"), {"many": [0.5]}).first().many is None

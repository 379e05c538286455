"""Neighbours and nearest cells against plain searches over random grids."""

import random

from pyspark.sql import functions as F

from gridloom.operators import history as hi
from gridloom.operators import neighbours as ne
from gridloom.plans.features import build_features

from .test_history import drawn_panel, months


def searched(cells, lat, lon):
    """(north, south, east, west) of a cell, by looking at all others."""
    same_lon, same_lat = [a for a, b in cells if b == lon], [b for a, b in cells if a == lat]
    pick = lambda xs, f: f(xs) if xs else None
    return (
        pick([a for a in same_lon if a > lat], min), pick([a for a in same_lon if a < lat], max),
        pick([b for b in same_lat if b > lon], min), pick([b for b in same_lat if b < lon], max),
    )


def test_lookup_equals_a_search(spark):
    r = random.Random(21)
    cells = sorted({(r.randrange(-6, 7) * 2.5, r.randrange(9) * 1.25) for _ in range(45)})
    df = spark.createDataFrame([(a, b, k) for a, b in cells for k in range(2)], "lat double, lon double, k int")
    got = {(x.lat, x.lon): (x.north, x.south, x.east, x.west) for x in ne.neighbour_lookup(df).collect()}
    assert got == {c: searched(cells, *c) for c in cells}


def holed(spark, seed):
    """A panel on an irregular grid; cells have different months."""
    r = random.Random(seed)
    cells = sorted({(r.randrange(5) * 10.0, r.randrange(5) * 10.0) for _ in range(16)})
    rows = [(a, b, t, None if r.random() < 0.3 else float(r.randrange(1000))) for a, b in cells for t in months((2007, 6), 9) if r.random() < 0.8]
    return spark.createDataFrame([(*x, x[3] is None) for x in rows], "lat double, lon double, time date, value double, masked boolean"), rows


def test_neighbours_bring_what_they_last_saw(spark):
    df, rows = holed(spark, 22)
    cells = sorted({x[:2] for x in rows})
    seen = {}
    for a, b, t, v in sorted(rows):
        before = max((k for k in seen if k[:2] == (a, b)), default=None)
        seen[a, b, t] = v if v is not None else seen[before] if before else None
    rows_of = lambda out: {(x.lat, x.lon, x.time): tuple(x[f"{s}_last_observed"] for s in ne.SIDES) for x in out.collect()}
    want = {}
    for a, b, t, _ in rows:
        n, s, e, w = searched(cells, a, b)
        want[a, b, t] = tuple(seen.get(k) for k in ((n, b, t), (s, b, t), (a, e, t), (a, w, t)))
    observed = df.withColumns(hi.last_observed())
    assert rows_of(ne.add_neighbours(observed)) == want
    assert rows_of(ne.add_neighbours(observed, cells=df.select("lat", "lon").distinct())) == want


def test_scatter_and_pull_agree(spark):
    df = holed(spark, 23)[0].withColumns(hi.last_observed())
    a, b = ne.add_neighbours(df), ne.add_neighbours_by_pull(df)
    assert a.select(*b.columns).exceptAll(b).count() == 0 == b.exceptAll(a.select(*b.columns)).count()
    assert a.where(F.col("north_months_since_observed") > 1).count() > 0 and ne.add_neighbours(df.where("false")).count() == 0


def test_draws_keep_to_themselves(spark):
    from dataclasses import replace

    from gridloom.operators.panel import PANEL

    df = holed(spark, 24)[0]
    twice = df.withColumn("draw", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("value", F.when((F.col("draw") == 0) | (F.month("time") != 8), F.col("value")))
    spec = replace(PANEL, keys=("draw", "lat", "lon"))
    both = ne.add_neighbours(twice.withColumns(hi.last_valued(spec)), spec)
    for k in (0, 1):
        alone = ne.add_neighbours(twice.where(F.col("draw") == k).drop("draw").withColumns(hi.last_valued()))
        own = both.where(F.col("draw") == k).select(*alone.columns)
        assert own.exceptAll(alone).count() == 0 == alone.exceptAll(own).count()


def test_features_compute_the_panel_once(spark, tmp_path):
    df, _ = drawn_panel(spark, 25)
    df.withColumn("is_train", F.lit(True)).write.parquet(f"{tmp_path}/panel")
    df.select("lat", "lon").distinct().write.parquet(f"{tmp_path}/cells")
    panel, cells = spark.read.parquet(f"{tmp_path}/panel"), spark.read.parquet(f"{tmp_path}/cells")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build_features(panel, cells=cells)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reads = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("/panel" in line for line in reads) == 1 and sum("/cells" in line for line in reads) == 1
    # the cells' windows, the cell's own history, and the meeting of neighbours; the lookup is broadcast
    assert plan.count("Exchange hashpartitioning") <= 6


def test_points_snap_to_the_nearest(spark):
    r = random.Random(26)
    ys, xs = [r.randrange(-90, 90) + 0.25 for _ in range(40)], [0.0, 7.0, 7.5, 120.0]
    cells = spark.createDataFrame([(a, b) for a in ys for b in xs], "lat double, lon double")
    points = [(k, r.uniform(-200, 200), r.choice([3.5, 7.25, 63.75, -4.0, 400.0])) for k in range(300)]  # ties among them
    points += [(300, None, 1.0), (301, float("nan"), None), *[(302, 10.1, 7.26)] * 200]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    near = lambda x, axis: None if x is None or x != x else min(axis, key=lambda v: (abs(v - x), v))
    key = lambda t: tuple(str(x) for x in t)
    for size in (0.5, 10.0, 1000.0):
        got = sorted(((p.id, p.lat, p.lon, p.near_lat, p.near_lon) for p in ne.nearest_cells(df, cells, size=size).collect()), key=key)
        assert list(map(key, got)) == sorted(key((i, y, x, near(y, ys), near(x, xs))) for i, y, x in points)
    assert ne.nearest_cells(df.limit(3), cells.where("false")).where("near_lat IS NOT NULL").count() == 0
    assert tuple(ne.nearest_point(cells, 300.0, 7.25).first()) == (max(ys), 7.0)

"""Checked and committed tables, breakdowns from one aggregate, streaks by cell, and draws by difference."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation as ev
from gridloom.operators import folds as fo
from gridloom.operators import history as hi
from gridloom.operators import outages as ou
from gridloom.operators import redraw as rd
from gridloom.operators.panel import PANEL, shared_columns
from gridloom.sources import tables as src

from .test_history import drawn_panel, months


def test_a_broken_rule_stops_the_commit(spark, tmp_path):
    df, _ = drawn_panel(spark, 31)
    rows = df.withColumns({"is_train": F.lit(True), "target": F.col("value")}).withColumns(hi.last_observed())
    found = src.checked_write(rows, f"{tmp_path}/good", src.feature_rules())
    assert found["rows"] == rows.count() == spark.read.parquet(f"{tmp_path}/good").count() and sum(found.values()) == found["rows"]
    for bad, rule in (
        (rows.withColumn("months_since_observed", F.lit(0)), "horizon_range"), (rows.withColumn("masked", ~F.col("masked")), "flag_and_value"),
        (rows.withColumn("is_train", F.lit(False)), "target_on_test"), (rows.withColumn("lat", F.lit(None).cast("double")), "no_key"),
    ):
        with pytest.raises(src.BrokenRule, match=rule):
            src.checked_write(bad, f"{tmp_path}/bad", src.feature_rules())
        assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]
    with pytest.raises(src.BrokenRule, match="no_template"):
        src.checked_write(rows.withColumn("ID", F.lit(None).cast("string")), f"{tmp_path}/bad", {"no_template": F.col("ID").isNull()})


def test_checks_scan_nothing_twice(spark, tmp_path):
    df, _ = drawn_panel(spark, 32)
    df.write.parquet(f"{tmp_path}/in")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.read.parquet(f"{tmp_path}/in")
    n = rows.count()
    src.checked_write(rows.mapInArrow(count, rows.schema), f"{tmp_path}/out", {"none": F.lit(False)})
    assert read.value == n


def test_a_killed_job_leaves_nothing_and_a_repeated_one_adds_nothing(spark, tmp_path):
    rows, path = spark.range(50).withColumn("x", F.col("id") * 2), f"{tmp_path}/t"
    mark = src.fingerprint(rows, "settings")
    assert mark == src.fingerprint(rows.repartition(7), "settings") != src.fingerprint(rows.where("id > 0"), "settings")
    killed = rows.withColumn("x", F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        src.commit_once(killed, path, mark)
    assert src.read_text(spark, f"{path}/_mark") is None and not (tmp_path / "t").exists()
    assert src.commit_once(rows, path, mark) and not src.commit_once(rows, path, mark)
    assert spark.read.parquet(path).count() == 50
    assert src.commit_once(rows.limit(3), path, "other") and spark.read.parquet(path).count() == 3


def test_one_file_in_template_order(spark, tmp_path):
    r = random.Random(33)
    rows = [(k, f"id {k},x" if k % 9 == 0 else f"id{k}", r.choice([r.uniform(-1e6, 1e6), r.randrange(-4000, 4000) / 8, None])) for k in range(900)]
    r.shuffle(rows)
    src.write_predictions(spark.createDataFrame(rows, "place int, ID string, Target double").repartition(5), f"{tmp_path}/p.csv")
    text = "ID,Target\n" + "".join(f'{chr(34) + i + chr(34) if "," in i else i},{"" if v is None else "%.2f" % v}\n' for _, i, v in sorted(rows))
    assert (tmp_path / "p.csv").read_bytes() == text.encode()
    bad = spark.createDataFrame([(1, "a", float("nan"))], "place int, ID string, Target double")
    with pytest.raises(Exception, match="no number of two decimals"):
        src.write_predictions(bad, f"{tmp_path}/p.csv")
    assert (tmp_path / "p.csv").read_bytes() == text.encode()


def test_manifest_is_read_back(spark, tmp_path):
    rows = spark.range(3).toDF("b").withColumns({"a": F.lit(1), "c": F.lit(2)})
    src.write_features(rows, f"{tmp_path}/f", ["c", "a", "b"])
    assert src.read_manifest(spark, f"{tmp_path}/f") == ["c", "a", "b"] and src.read_manifest(spark, f"{tmp_path}/f", ("a",)) == ["c", "b"]
    assert shared_columns(rows, rows.select("c", "b"), rows.drop("a")) == ["b", "c"]


def test_breakdowns_equal_single_ones(spark):
    r = random.Random(34)
    rows = [(r.choice(["x", "y", None]), r.choice(["x", None, "z"]), r.choice([1, 2, None]), r.choice([0.5, 2.0, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c int, abs_error double")
    got = sorted((x.dimension, x.value, round(x.mae, 9), x.n) for x in ev.error_breakdowns(df, ("a", "b", "c")).collect())
    want = sorted((d, str(x[d]), round(x.mae, 9), x.n) for d in ("a", "b", "c") for x in ev.error_by(df, d).collect())
    assert got == want and len(got) == 6
    assert ev.error_breakdowns(df.where("false"), ("a", "b")).count() == 0


def test_streaks_of_cells(spark):
    df, series = drawn_panel(spark, 35)
    want = set()
    for cell, steps in series.items():
        run = []
        for t, v in steps:
            if v is None:
                run = run if run and (t.year * 12 + t.month) == (run[-1].year * 12 + run[-1].month) + 1 else []
                run.append(t)
                want.add((*cell, t, run[0], len(run)))
    got = {tuple(r) for r in ou.streaks(df.where("value IS NULL"), by=("lat", "lon")).collect()}
    assert got == want
    assert {tuple(r) for r in ou.capped(df.where("value IS NULL"), 1, by=("lat", "lon")).collect()} == {w[:3] for w in want if w[4] == 1}


def test_roles_hold_rows_back(spark):
    df = spark.createDataFrame([(float(a), float(b), t) for a in range(0, 60, 10) for b in (0, 10) for t in months((2001, 1), 24)], "lat double, lon double, time date")
    for rows in (fo.temporal_roles(df, 3, 0.2), fo.spatial_roles(df, 3, 10.0, 0.2)):
        for f in range(3):
            own = rows.where(F.col("fold") == f)
            n = own.where("role = 'fit'").count()
            assert own.where("stop").count() == max(1, int(0.2 * n)) and own.where("stop AND role = 'val'").count() == 0
    time = fo.temporal_roles(df, 3, 0.2).collect()
    assert all(max(r.time for r in time if r.fold == f and r.role == "fit" and not r.stop) < min(r.time for r in time if r.fold == f and r.stop) for f in range(3))


@pytest.mark.parametrize("seed", [36, 37])
def test_draws_by_difference_equal_whole_draws(spark, tmp_path, seed):
    df, _ = drawn_panel(spark, seed)
    r = random.Random(seed)
    rows = df.withColumn("is_train", F.col("time") < dt.date(1994, 1, 1)).withColumn("value", (F.col("value") * 4).cast("long"))
    gaps = {0: set(), 1: set(r.sample(months((1991, 4), 40), 6)), 2: {dt.date(1993, 9, 1)}, 5: set(months((1991, 4), 40))}
    path = f"{tmp_path}/stored"
    rd.unmasked_features(rows).write.parquet(path)
    stored = spark.read.parquet(path)
    drawn, spec = ou.many_draws(rows, gaps)
    drawn = drawn.withColumns(hi.lags("value", rd.LAGS, spec) | hi.rolling_means("value", rd.WIDTHS, spec) | hi.climatology(spec) | hi.last_valued(spec)).withColumns(hi.differences("value", rd.DIFFS))
    drawn = drawn.withColumns(hi.trend(tuple(f"value_diff{k}" for k in rd.DIFFS), spec))
    names = ["draw", "lat", "lon", "time", "value", "masked", *rd.feature_names(PANEL)]
    changed, untouched = rd.redrawn(stored, gaps)
    got = changed.unionByName(untouched).select(*names)
    assert got.exceptAll(drawn.select(*names)).count() == 0 == drawn.select(*names).exceptAll(got).count()
    recomputed = {x.draw: x["count"] for x in changed.groupBy("draw").count().collect()}
    print("rows recomputed by draw", recomputed, "of", stored.count())
    assert 0 not in recomputed and recomputed[2] < stored.count() / 2 < recomputed[5]


def test_draws_run_where_stored_cells_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "BUCKET_ROWS", 100)
    df, _ = drawn_panel(spark, 38)
    rows = df.withColumn("is_train", F.col("time") < dt.date(1994, 1, 1)).withColumn("value", (F.col("value") * 4).cast("long"))
    gaps = {0: set(), 1: {dt.date(1992, 3, 1), dt.date(1993, 5, 1)}, 2: {dt.date(1993, 9, 1)}}
    rd.unmasked_features(rows).write.parquet(f"{tmp_path}/plain")
    stored = rd.store_by_cell(rows, rows.count(), f"{tmp_path}/buckets")
    names = ["draw", "lat", "lon", "time", "value", "masked", *rd.feature_names(PANEL)]
    for some in (gaps, {1: gaps[1]}):
        drawn = rd.many_redrawn(stored, some)
        # no row is exchanged, neither once a draw nor before it
        assert "Exchange hashpartitioning" not in drawn._jdf.queryExecution().executedPlan().toString()
        plain = rd.many_redrawn(spark.read.parquet(f"{tmp_path}/plain"), some).select(*names)
        assert drawn.select(*names).exceptAll(plain).count() == 0 == plain.exceptAll(drawn.select(*names)).count() and drawn.count() == len(some) * rows.count()

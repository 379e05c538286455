"""All queries over the driver's tables by name, and SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import cyclic_month, latitude_band
from ..operators import evaluation as ev
from ..operators import folds as fo
from ..operators import forecast as fc
from ..operators import history as hi
from ..operators import neighbours as ne
from ..operators import network as nw
from ..operators import outages as ou
from ..operators import redraw as rd
from ..operators.panel import PANEL, broken_rules, feature_columns, split_panel, union_panels
from ..sources import tables as src
from ..streaming import arrivals
from .features import VARIANTS, build_features, not_features, variant

#: Months that queries treat as outages, and rates of outage by year.
GAP = [dt.date(1996, 3, 1), dt.date(1996, 4, 1), dt.date(1997, 1, 1), dt.date(1998, 7, 1), dt.date(1998, 8, 1), dt.date(1998, 9, 1), dt.date(1998, 10, 1), dt.date(1999, 12, 1)]
RATES = [(1995, 1996, 0.05), (1997, 1998, 0.35), (1999, 1999, 0.5)]
ID = ["lat", "lon", "time"]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

_gap = ", ".join(f"DATE '{d}'" for d in GAP)
#: The panel of the adapters in SQL; ``g`` is the panel with the outage months masked.
CTE = f"""
WITH raw AS (SELECT CAST(l_suppkey // 10 * 67 % 180 - 89.5 AS DOUBLE) AS lat, CAST(l_suppkey % 10 + l_suppkey // 1800 * 10 AS DOUBLE) AS lon, CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS cov_quantity,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS cov_discount, count(*) AS cov_count
    FROM lineitem GROUP BY 1, 2, 3),
flags AS (SELECT *, time < DATE '2000-01-01' AS is_train, time >= DATE '2000-01-01' AND (year(time) * 12 + month(time)) % 5 = 2 AS masked FROM raw),
panel AS (SELECT r.lat, r.lon, r.time, CASE WHEN NOT r.masked THEN r.v END AS value, r.cov_quantity, r.cov_discount, r.cov_count, r.masked, r.is_train,
    CASE WHEN r.is_train THEN n.v END AS target
    FROM flags r LEFT JOIN raw n ON r.lat = n.lat AND r.lon = n.lon AND n.time = CAST(r.time + INTERVAL 1 MONTH AS DATE)),
g AS (SELECT lat, lon, time, CASE WHEN is_train AND time IN ({_gap}) THEN NULL ELSE value END AS value, cov_quantity, cov_discount, cov_count,
    masked OR (is_train AND time IN ({_gap})) AS masked, is_train, target FROM panel),
h AS (SELECT *, avg(value) OVER (PARTITION BY lat, lon, month(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS climatology_mean,
    last_value(CASE WHEN NOT masked THEN value END IGNORE NULLS) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_observed,
    last_value(CASE WHEN NOT masked THEN time END IGNORE NULLS) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_time
    FROM g),
o AS (SELECT *, CAST(datediff('month', last_time, time) + 1 AS INTEGER) AS months_since_observed, coalesce(CAST(last_observed AS DOUBLE), climatology_mean) AS prediction FROM h),
months AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT time FROM panel WHERE is_train)),
folds AS (SELECT time, fold, CASE WHEN k < m - (5 - fold) * (m // 6) THEN 'fit' ELSE 'val' END AS role FROM months, range(5) AS f(fold) WHERE k < m - (5 - fold) * (m // 6) + m // 6),
oof AS (SELECT o.*, CAST(folds.fold AS INTEGER) AS fold, abs(target - prediction) AS abs_error FROM o JOIN folds ON o.time = folds.time AND role = 'val' WHERE target IS NOT NULL)
"""


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = (CTE.replace("WITH raw", "WITH RECURSIVE raw", 1) if "sr AS" in sql else CTE) + sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``; without that setting, in a temporary folder on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.supplier_month(spark, sf_dir)


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ou.mask_months(panel(spark, sf_dir), GAP)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked panel with last observation, horizon, climatology and the persistence forecast."""
    rows = gapped(spark, sf_dir).withColumns(hi.last_observed() | hi.climatology())
    return rows.withColumn("prediction", ev.persistence())


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a fold is judged on, with the forecast's error."""
    table = fo.temporal_folds(panel(spark, sf_dir).where("is_train"), 5).where("role = 'val'")
    rows = fo.with_time_folds(observed(spark, sf_dir), table).where("target IS NOT NULL")
    return rows.withColumn("abs_error", F.abs(F.col("target") - F.col("prediction")))


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


W = "OVER (PARTITION BY lat, lon ORDER BY time)"


# --- the panel itself
@query("SELECT * FROM panel")
def panel_union_flags(spark, d):
    train, test = split_panel(panel(spark, d))
    return union_panels(train.drop("masked"), test).select("lat", "lon", "time", "value", "cov_quantity", "cov_discount", "cov_count", "masked", "is_train", "target")


@query("SELECT lat, lon, time, value, target FROM panel WHERE is_train")
def csv_roundtrip_scan(spark, d):
    path = shared(spark, "csv")
    train = panel(spark, d).where("is_train").select(F.concat_ws("_", F.date_format("time", "yyyyMMdd"), "lat", "lon").alias("sample_id"), "time", "lat", "lon", "value", "target")
    train.write.mode("overwrite").option("header", True).csv(f"{path}/train")
    return src.scan_csv(spark, f"{path}/train", "sample_id string, time date, lat double, lon double, value long, target long").select("lat", "lon", "time", "value", "target")


@query("SELECT 'repeated_step' AS rule, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'flag_and_value', count(*) FILTER (WHERE masked <> (value IS NULL)) FROM panel UNION ALL SELECT 'target_on_test', count(*) FILTER (WHERE NOT is_train AND target IS NOT NULL) FROM panel")
def panel_rules(spark, d):
    return broken_rules(panel(spark, d))


@query("""SELECT CAST(floor(c_nationkey / 5) AS DOUBLE) AS lat, CAST(c_nationkey % 5 AS DOUBLE) AS lon, CAST(date_trunc('month', o_orderdate) AS DATE) AS time,
    CASE WHEN NOT (date_trunc('month', o_orderdate) >= DATE '2000-01-01' AND (year(any_value(o_orderdate)) * 12 + month(any_value(o_orderdate))) % 5 = 2) THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) END AS value, count(*) AS cov_count
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, date_trunc('month', o_orderdate)""")
def nation_panel(spark, d):
    return src.nation_month(spark, d).select("lat", "lon", "time", "value", "cov_count")


@query("""SELECT lat, lon, time, avg(value) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_rollmean3, lag(value, 1) OVER (PARTITION BY lat, lon ORDER BY time) AS value_lag1
    FROM (SELECT CAST(floor(user_id / 10) AS DOUBLE) AS lat, CAST(user_id % 10 AS DOUBLE) AS lon, CAST(ts AS DATE) AS time, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2, 3)""")
def user_day_steps(spark, d):
    return src.user_day(spark, d).select(*ID, *[c.alias(n) for n, c in (hi.rolling_means("value", (3,)) | hi.lags("value", (1,))).items()])


# --- history
@query(f"SELECT lat, lon, time, lag(value, 1) {W} AS value_lag1, lag(value, 3) {W} AS value_lag3, lag(value, 6) {W} AS value_lag6, lag(value, 12) {W} AS value_lag12 FROM g")
def step_lags(spark, d):
    return gapped(spark, d).withColumns(hi.lags("value", (1, 3, 6, 12))).select(*ID, "value_lag1", "value_lag3", "value_lag6", "value_lag12")


@query(f"SELECT lat, lon, time, value - lag(value, 1) {W} AS value_diff1, value - lag(value, 12) {W} AS value_diff12 FROM g")
def step_diffs(spark, d):
    return gapped(spark, d).withColumns(hi.lags("value", (1, 12))).withColumns(hi.differences("value", (1, 12))).select(*ID, "value_diff1", "value_diff12")


@query("SELECT lat, lon, time, " + ", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" for c in PANEL.covariates for k in (1, 3)) + " FROM g")
def covariate_lags(spark, d):
    cols = {}
    for c in PANEL.covariates:
        cols |= hi.lags(c, (1, 3))
    return gapped(spark, d).withColumns(cols).select(*ID, *cols)


@query("SELECT lat, lon, time, " + ", ".join(f"avg(value) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS value_rollmean{n}" for n in (3, 6, 12)) + " FROM g")
def rolling_means(spark, d):
    cols = hi.rolling_means("value", (3, 6, 12))
    return gapped(spark, d).withColumns(cols).select(*ID, *cols)


_T = "OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_TREND = ", ".join(f"avg(value_diff{k}) {_T} AS value_diff{k}_trend_mean, CASE WHEN row_number() {W} > 1 THEN count(value_diff{k}) {_T} END AS value_diff{k}_trend_count" for k in (1, 12))


@query(f"SELECT lat, lon, time, {_TREND} FROM (SELECT *, value - lag(value, 1) {W} AS value_diff1, value - lag(value, 12) {W} AS value_diff12 FROM g)")
def trend_mean_count(spark, d):
    cols = hi.trend(("value_diff1", "value_diff12"))
    return gapped(spark, d).withColumns(hi.lags("value", (1, 12))).withColumns(hi.differences("value", (1, 12))).withColumns(cols).select(*ID, *cols)


_S = "OVER (PARTITION BY lat, lon, month(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT lat, lon, time, climatology_mean, CASE WHEN row_number() OVER (PARTITION BY lat, lon, month(time) ORDER BY time) > 1 THEN count(value) {_S} END AS climatology_count, value - climatology_mean AS anomaly FROM h")
def climatology_mean_count_anomaly(spark, d):
    cols = hi.climatology()
    return gapped(spark, d).withColumns(cols).select(*ID, *cols)


@query("SELECT lat, lon, time, last_observed, months_since_observed FROM o")
def horizon_last_observed(spark, d):
    return observed(spark, d).select(*ID, "last_observed", "months_since_observed")


@query("SELECT months_since_observed, count(*) AS n FROM o GROUP BY 1")
def horizon_histogram(spark, d):
    return observed(spark, d).groupBy("months_since_observed").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT time, round(sin(2 * pi() * month(time + INTERVAL 1 MONTH) / 12), 6) + 0.0 AS target_month_sin, round(cos(2 * pi() * month(time + INTERVAL 1 MONTH) / 12), 6) + 0.0 AS target_month_cos FROM panel")
def target_month_cyclic(spark, d):
    return panel(spark, d).select("time").distinct().withColumns(cyclic_month("time")).select("time", (F.round("target_month_sin", 6) + 0.0).alias("target_month_sin"), (F.round("target_month_cos", 6) + 0.0).alias("target_month_cos"))


# --- neighbours
_LOOKUP = """(SELECT lat, lon, lead(lat) OVER (PARTITION BY lon ORDER BY lat) AS north, lag(lat) OVER (PARTITION BY lon ORDER BY lat) AS south,
    lead(lon) OVER (PARTITION BY lat ORDER BY lon) AS east, lag(lon) OVER (PARTITION BY lat ORDER BY lon) AS west FROM (SELECT DISTINCT lat, lon FROM panel))"""


@query(f"SELECT * FROM {_LOOKUP}")
def neighbor_lookup(spark, d):
    return ne.neighbour_lookup(panel(spark, d))


_JOINS = " ".join(f"LEFT JOIN o {s[0]} ON {s[0]}.time = o.time AND {s[0]}.lat = {'l.' + s if s in ('north', 'south') else 'o.lat'} AND {s[0]}.lon = {'l.' + s if s in ('east', 'west') else 'o.lon'}" for s in ne.SIDES)
_SIDES = ", ".join(f"{s[0]}.{c} AS {s}_{c}" for s in ne.SIDES for c in ne.CARRIED)
_NEAR = f"SELECT o.lat, o.lon, o.time, {_SIDES} FROM o JOIN {_LOOKUP} l ON o.lat = l.lat AND o.lon = l.lon {_JOINS}"


@query(_NEAR)
def neighbor_last_observed(spark, d):
    return ne.add_neighbours(observed(spark, d), cells=src.supplier_cells(spark, d)).select(*ID, *[f"{s}_{c}" for s in ne.SIDES for c in ne.CARRIED])


@query("SELECT (SELECT lat FROM panel ORDER BY abs(lat - 3.4), lat LIMIT 1) AS lat, (SELECT lon FROM panel ORDER BY abs(lon - 7.6), lon LIMIT 1) AS lon")
def nearest_grid_point(spark, d):
    return ne.nearest_point(panel(spark, d).select("lat", "lon").distinct(), 3.4, 7.6)


_SNAP = {"lat": "CAST(c_acctbal / 61 - 40 AS DOUBLE)", "lon": "CAST(c_custkey % 1300 / 100 AS DOUBLE)"}


@query(f""", pt AS (SELECT c_custkey, {_SNAP["lat"]} AS lat, {_SNAP["lon"]} AS lon FROM customer), ya AS (SELECT DISTINCT lat AS v FROM panel), xa AS (SELECT DISTINCT lon AS v FROM panel)
    SELECT c_custkey, lat, lon, (SELECT arg_min(v, row(abs(v - pt.lat), v)) FROM ya) AS near_lat, (SELECT arg_min(v, row(abs(v - pt.lon), v)) FROM xa) AS near_lon FROM pt""")
def nearest_cells(spark, d):
    """Each customer's point with the nearest latitude and longitude of the grid."""
    points = src.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 61 - 40).cast("double").alias("lat"), (F.col("c_custkey") % 1300 / 100).cast("double").alias("lon"))
    return ne.nearest_cells(points, src.supplier_cells(spark, d))


# --- outages
@query("SELECT lat, lon, time, value, masked, target FROM g")
def mask_months_apply(spark, d):
    return gapped(spark, d).select(*ID, "value", "masked", "target")


@query("SELECT DISTINCT time, CASE WHEN year(time) BETWEEN 1995 AND 1996 THEN 0.1::DOUBLE WHEN year(time) BETWEEN 1997 AND 1998 THEN 0.7::DOUBLE WHEN year(time) = 1999 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM panel")
def gap_rate_by_period(spark, d):
    return panel(spark, d).select("time").distinct().withColumn("rate", ou.rate_column(F.col("time"), ou.scaled(RATES, 2.0)))


_STREAKS = f"(SELECT time, min(time) OVER (PARTITION BY i) AS streak, row_number() OVER (PARTITION BY i ORDER BY time) AS place FROM (SELECT time, year(time) * 12 + month(time) - row_number() OVER (ORDER BY time) AS i FROM unnest([{_gap}]) AS t(time)))"


def _gap_table(spark):
    return spark.createDataFrame([(x,) for x in GAP], "time date")


_UNSEEN = "(SELECT time, min(time) OVER (PARTITION BY i) AS streak, row_number() OVER (PARTITION BY i ORDER BY time) AS place FROM (SELECT time, year(time) * 12 + month(time) - row_number() OVER (ORDER BY time) AS i FROM g GROUP BY time HAVING count(value) = 0))"


@query(f"SELECT time, streak, CAST(place AS INTEGER) AS place FROM {_UNSEEN}")
def gap_streaks(spark, d):
    """Runs of months in which no cell has a value."""
    return ou.streaks(ou.months_without_value(gapped(spark, d)))


@query(f"SELECT time FROM {_UNSEEN} WHERE place <= 3")
def gap_streaks_capped(spark, d):
    return ou.capped(ou.months_without_value(gapped(spark, d)), 3)


_BY_CELL = "(SELECT lat, lon, time, min(time) OVER (PARTITION BY lat, lon, i) AS streak, row_number() OVER (PARTITION BY lat, lon, i ORDER BY time) AS place FROM (SELECT lat, lon, time, year(time) * 12 + month(time) - row_number() OVER (PARTITION BY lat, lon ORDER BY time) AS i FROM g WHERE value IS NULL))"


@query(f"SELECT lat, lon, time, streak, CAST(place AS INTEGER) AS place FROM {_BY_CELL} WHERE place <= 2")
def cell_streaks_capped(spark, d):
    """Each cell's runs of months without a value, the first two months of each."""
    return ou.streaks(gapped(spark, d).where("value IS NULL"), by=("lat", "lon")).where("place <= 2")


@query(f""", ex AS (SELECT time, row_number() OVER (ORDER BY time) AS k FROM (SELECT DISTINCT time FROM panel WHERE is_train)),
    e AS (SELECT streak, max(time) AS time, count(*) AS n FROM {_STREAKS} GROUP BY streak),
    t AS (SELECT e.streak, b.time, 4 - e.n AS more FROM e JOIN ex a ON a.time = e.time JOIN ex b ON b.k > a.k AND b.k <= a.k + 4 - e.n WHERE e.n < 4),
    s AS (SELECT streak FROM t GROUP BY streak, more HAVING count(*) = more AND count(*) FILTER (WHERE time IN ({_gap})) = 0)
    SELECT time FROM unnest([{_gap}]) AS x(time) UNION SELECT time FROM t WHERE streak IN (SELECT streak FROM s)""")
def gap_streaks_extended(spark, d):
    return ou.extended(_gap_table(spark), panel(spark, d).where("is_train"), 4)


_FIRSTS = [dt.date(1996, 3, 1), dt.date(1997, 1, 1), dt.date(1998, 7, 1), dt.date(1999, 12, 1)]


def _lengths() -> list[tuple[dt.date, int]]:
    import numpy as np

    return ou.drawn_lengths(_FIRSTS, (2, 4, 5, 7), np.random.default_rng(3))


@query(f""", ex AS (SELECT time, row_number() OVER (ORDER BY time) AS k FROM (SELECT DISTINCT time FROM panel WHERE is_train)),
    w AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{m}', {n})" for m, n in _lengths())}) AS v(streak, length)),
    e AS (SELECT streak, max(time) AS time, any_value(length) - count(*) AS more FROM {_STREAKS} JOIN w USING (streak) GROUP BY streak),
    t AS (SELECT e.streak, b.time, more FROM e JOIN ex a ON a.time = e.time JOIN ex b ON b.k > a.k AND b.k <= a.k + more WHERE more > 0),
    s AS (SELECT streak FROM t GROUP BY streak, more HAVING count(*) = more AND count(*) FILTER (WHERE time IN ({_gap})) = 0)
    SELECT time FROM unnest([{_gap}]) AS x(time) UNION SELECT time FROM t WHERE streak IN (SELECT streak FROM s)""")
def gap_streaks_drawn(spark, d):
    """Each streak extended to a length drawn for it."""
    return ou.extended(_gap_table(spark), panel(spark, d).where("is_train"), spark.createDataFrame(_lengths(), "streak date, length int"))


@query("SELECT lat, lon, count(*) FILTER (WHERE masked AND NOT p) AS runs, coalesce(min(time) FILTER (WHERE masked) > max(time) FILTER (WHERE NOT masked), false) AS cumulative FROM (SELECT *, coalesce(lag(masked) OVER (PARTITION BY lat, lon ORDER BY time), false) AS p FROM g) GROUP BY lat, lon")
def masked_run_counts(spark, d):
    return hi.masked_runs(gapped(spark, d))


@query("SELECT time, count(*) AS n, count(*) FILTER (WHERE masked) AS masked, round(100.0 * count(*) FILTER (WHERE masked) / count(*), 1) AS pct FROM g GROUP BY time")
def mask_rate_by_month(spark, d):
    return gapped(spark, d).groupBy("time").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"), F.round(100.0 * F.count_if("masked") / F.count("*"), 1).alias("pct"))


#: What seed 42 draws from the train months of the driver's tables.
TRAIN_MONTHS = [dt.date(y, m, 1) for y in range(1995, 2000) for m in range(1, 13)]


def _drawn(seed: int, factor: float = 1.0) -> str:
    import numpy as np

    return ", ".join(f"DATE '{m}'" for m in sorted(ou.draw_months(TRAIN_MONTHS, ou.scaled(RATES, factor), np.random.default_rng(seed))))


@query(f"SELECT lat, lon, time, CASE WHEN is_train AND time IN ({_drawn(42)}) THEN NULL ELSE value END AS value, masked OR (is_train AND time IN ({_drawn(42)})) AS masked FROM panel")
def outage_draw(spark, d):
    """A seeded draw over the train months."""
    import numpy as np

    rows = panel(spark, d)
    return ou.mask_months(rows, ou.draw_months(ou.train_months(rows), RATES, np.random.default_rng(42))).select(*ID, "value", "masked")


_DRAWS = {0: {dt.date(1996, 3, 1)}, 1: {dt.date(1997, 1, 1), dt.date(1998, 7, 1)}, 2: set()}
_HIT = " OR ".join(f"(x.draw = {k} AND time IN ({', '.join(f'DATE {str(m)!r}' for m in sorted(v))}))" for k, v in _DRAWS.items() if v)
_DW = "OVER (PARTITION BY draw, lat, lon ORDER BY time"
_DS = "OVER (PARTITION BY draw, lat, lon, month(time) ORDER BY time"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f""", dr AS (SELECT CAST(x.draw AS INTEGER) AS draw, lat, lon, time, CASE WHEN is_train AND ({_HIT}) THEN NULL ELSE value END AS value FROM panel, (VALUES (0), (1), (2)) AS x(draw)),
    dl AS (SELECT *, {", ".join(f"lag(value, {k}) {_DW}) AS value_lag{k}" for k in (1, 3, 6, 12))}, {", ".join(f"avg(value) {_DW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS value_rollmean{n}" for n in (3, 6, 12))},
    avg(value) {_DS} {_BEFORE} AS climatology_mean, CASE WHEN row_number() {_DS}) > 1 THEN count(value) {_DS} {_BEFORE} END AS climatology_count,
    last_value(value IGNORE NULLS) {_DW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_observed,
    last_value(CASE WHEN value IS NOT NULL THEN time END IGNORE NULLS) {_DW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lt FROM dr),
    dd AS (SELECT *, value - value_lag1 AS value_diff1, value - value_lag12 AS value_diff12 FROM dl)
    SELECT draw, lat, lon, time, {", ".join(f"value_lag{k}" for k in (1, 3, 6, 12))}, {", ".join(f"value_rollmean{n}" for n in (3, 6, 12))}, climatology_mean, climatology_count, value - climatology_mean AS anomaly, last_observed,
    CAST(datediff('month', lt, time) + 1 AS INTEGER) AS months_since_observed, value_diff1, value_diff12,
    {", ".join(f"avg(value_diff{k}) {_DW} {_BEFORE} AS value_diff{k}_trend_mean, CASE WHEN row_number() {_DW}) > 1 THEN count(value_diff{k}) {_DW} {_BEFORE} END AS value_diff{k}_trend_count" for k in (1, 12))} FROM dd""")
def features_of_many_draws(spark, d):
    """All features that depend on the value, for several outage draws in one plan; a step counts as seen where it has a value."""
    rows, spec = ou.many_draws(panel(spark, d).select(*ID, "value", "masked", "is_train"), _DRAWS)
    rows = rows.withColumns(hi.lags("value", (1, 3, 6, 12), spec) | hi.rolling_means("value", (3, 6, 12), spec) | hi.climatology(spec) | hi.last_valued(spec))
    rows = rows.withColumns(hi.differences("value", (1, 12)))
    return rows.withColumns(hi.trend(("value_diff1", "value_diff12"), spec)).drop("value", "masked", "is_train")


def features_of_draws_by_difference(spark, d):
    """The same from stored unmasked features: only rows that a draw's months touch are computed anew."""
    path = shared(spark, "unmasked")
    rd.unmasked_features(panel(spark, d).select(*ID, "value", "masked", "is_train")).write.parquet(path)
    return rd.many_redrawn(spark.read.parquet(path), _DRAWS).drop("value", "masked", "is_train")


_queries["features_of_draws_by_difference"] = features_of_draws_by_difference
_sql["features_of_draws_by_difference"] = _sql["features_of_many_draws"]


# --- sets and statistics
@query("SELECT lat, lon, CAST(m AS DATE) AS time FROM (SELECT lat, lon, unnest(generate_series(min(time), max(time), INTERVAL 1 MONTH)) AS m FROM panel GROUP BY lat, lon) EXCEPT SELECT lat, lon, time FROM panel")
def missing_calendar_months(spark, d):
    rows = panel(spark, d)
    every = rows.groupBy("lat", "lon").agg(F.sequence(F.min("time"), F.max("time"), F.expr("interval 1 month")).alias("s")).select("lat", "lon", F.explode("s").alias("time"))
    return every.subtract(rows.select(*ID))


@query("SELECT DISTINCT lat, lon FROM panel WHERE time < DATE '1996-01-01' EXCEPT SELECT lat, lon FROM panel WHERE time >= DATE '1996-01-01' AND cov_count > 14")
def cells_only_in_train(spark, d):
    rows = panel(spark, d)
    early, late = rows.where("time < DATE '1996-01-01'"), rows.where("time >= DATE '1996-01-01' AND cov_count > 14")
    return early.select("lat", "lon").distinct().join(late.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti")


@query("SELECT lat, lon, count(DISTINCT time) AS months FROM panel GROUP BY lat, lon")
def months_per_cell(spark, d):
    return panel(spark, d).groupBy("lat", "lon").agg(F.countDistinct("time").alias("months"))


@query("SELECT lat, lon, max(time) AS time FROM panel WHERE is_train GROUP BY lat, lon")
def last_train_month(spark, d):
    return panel(spark, d).where("is_train").groupBy("lat", "lon").agg(F.max("time").alias("time"))


@query('SELECT \'value\' AS "column", round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100, 6) AS share FROM g UNION ALL SELECT \'target\', round(avg(CASE WHEN target IS NULL THEN 1 ELSE 0 END) * 100, 6) FROM g')
def null_share(spark, d):
    return ev.null_shares(gapped(spark, d), "value", "target").select("column", _r("share"))


@query("SELECT count(value) AS count, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, min(value)::DOUBLE AS min, round(quantile_cont(value, 0.25), 3)::DOUBLE AS q25, round(quantile_cont(value, 0.5), 3)::DOUBLE AS q50, round(quantile_cont(value, 0.75), 3)::DOUBLE AS q75, max(value)::DOUBLE AS max FROM g")
def describe_numeric(spark, d):
    return ev.describe(gapped(spark, d), "value").select("count", _r("mean", 3), _r("std", 3), "min", _r("q25", 3), _r("q50", 3), _r("q75", 3), "max")


@query(f"SELECT round(corr(target, value), 6) AS value, round(corr(target, l), 6) AS value_lag1 FROM (SELECT *, lag(value, 1) {W} AS l FROM g)")
def lag_target_corr(spark, d):
    rows = gapped(spark, d).withColumns(hi.lags("value", (1,)))
    return rows.agg(F.round(F.corr("target", "value"), 6).alias("value"), F.round(F.corr("target", "value_lag1"), 6).alias("value_lag1"))


@query("SELECT CAST(month(time) AS INTEGER) AS month, avg(value) AS mean FROM g GROUP BY 1")
def seasonal_cycle(spark, d):
    return gapped(spark, d).groupBy(F.month("time").alias("month")).agg(F.avg("value").alias("mean"))


@query("SELECT CAST(month(time) AS INTEGER) AS month, " + ", ".join(f"avg(value) FILTER (WHERE lat > {a} AND lat <= {a + 20}) AS band{k}" for k, a in enumerate(range(-90, 90, 20))) + " FROM g GROUP BY 1")
def seasonal_by_lat_band_pivot(spark, d):
    rows = gapped(spark, d).withColumn("band", latitude_band("lat"))
    return rows.groupBy(F.month("time").alias("month")).pivot("band", [f"({a}, {a + 20}]" for a in range(-90, 90, 20)]).agg(F.avg("value")).toDF("month", *[f"band{k}" for k in range(9)])


@query("SELECT lat, " + ", ".join(f"max(value) FILTER (WHERE lon = {k}) AS lon{k}" for k in range(10)) + " FROM panel WHERE time = DATE '1998-01-01' GROUP BY lat")
def grid_pivot(spark, d):
    rows = panel(spark, d).where("time = DATE '1998-01-01'")
    grid = rows.withColumn("lon", F.concat(F.lit("lon"), F.col("lon").cast("int"))).groupBy("lat").pivot("lon", [f"lon{k}" for k in range(10)]).agg(F.first("value"))
    return grid


@query("SELECT CAST(least(floor((value - a) / (b - a) * 60), 59) AS INTEGER) AS bin, count(*) AS n FROM (SELECT value, min(value) OVER ()::DOUBLE AS a, max(value) OVER ()::DOUBLE AS b FROM g WHERE value IS NOT NULL) GROUP BY 1")
def value_histogram(spark, d):
    return ev.histogram(gapped(spark, d), "value", 60)


@query("SELECT quantile_cont(value, 0.01)::DOUBLE AS p1, quantile_cont(value, 0.99)::DOUBLE AS p99 FROM g")
def value_percentiles(spark, d):
    return ev.percentiles(gapped(spark, d), {"value": [0.01, 0.99]}).select(F.col("value")[0].alias("p1"), F.col("value")[1].alias("p99"))


# --- folds
@query("SELECT time, CAST(fold AS INTEGER) AS fold, role FROM folds")
def temporal_folds(spark, d):
    return fo.temporal_folds(panel(spark, d).where("is_train"), 5)


@query("SELECT time, CASE WHEN k >= greatest(1, CAST(floor(m * (1 - 0.2::DOUBLE)) AS INTEGER)) THEN 'val' ELSE 'fit' END AS role FROM months")
def temporal_holdout(spark, d):
    return fo.temporal_holdout(panel(spark, d).where("is_train"), 0.2)


@query("SELECT time, CASE WHEN k < floor(m * (1 - 0.15::DOUBLE - 0.15::DOUBLE)) THEN 'fit' WHEN k < floor(m * (1 - 0.15::DOUBLE)) THEN 'inner_val' ELSE 'outer_val' END AS role FROM months")
def two_tier_split(spark, d):
    return fo.two_tier_split(panel(spark, d).where("is_train"))


@query("SELECT CAST(floor(lat / 4) AS INTEGER) || '_' || CAST(floor(lon / 4) AS INTEGER) AS block, count(*) AS n FROM panel GROUP BY 1")
def spatial_blocks(spark, d):
    return panel(spark, d).groupBy(fo.block(size=4.0).alias("block")).agg(F.count("*").alias("n"))


#: Blocks one after the other, each to the fold with the fewest rows so far.
SPATIAL = """sb AS (SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS i FROM (SELECT CAST(floor(lat / 4) AS INTEGER) || '_' || CAST(floor(lon / 4) AS INTEGER) AS block, count(*) AS n FROM panel GROUP BY 1)),
    sr AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS held, CAST(NULL AS VARCHAR) AS block, CAST(NULL AS INTEGER) AS fold UNION ALL
        SELECT sb.i, list_transform(held, lambda x, j: CASE WHEN j = list_position(held, list_min(held)) THEN x + sb.n ELSE x END), sb.block, CAST(list_position(held, list_min(held)) - 1 AS INTEGER) FROM sr JOIN sb ON sb.i = sr.i + 1)"""


@query(", " + SPATIAL + " SELECT block, fold FROM sr WHERE i > 0")
def spatial_folds(spark, d):
    return fo.spatial_folds(panel(spark, d), 5, 4.0)


@query("SELECT block, CASE WHEN row_number() OVER (ORDER BY md5('0|' || block), block) <= greatest(1, CAST(floor(0.2::DOUBLE * count(*) OVER ()) AS BIGINT)) THEN 'val' ELSE 'fit' END AS role FROM (SELECT DISTINCT CAST(floor(lat / 4) AS INTEGER) || '_' || CAST(floor(lon / 4) AS INTEGER) AS block FROM panel)")
def spatial_holdout(spark, d):
    return fo.spatial_holdout(panel(spark, d), 0.2, 4.0)


# --- forecasts and errors
@query("SELECT lat, lon, time, prediction FROM o")
def persistence_forecast(spark, d):
    return observed(spark, d).select(*ID, "prediction")


_METRICS = "count(*) AS n, round(avg(abs_error), 3) AS mae, round(sqrt(avg(abs_error * abs_error)), 3) AS rmse, round(1 - sum(abs_error * abs_error) / (var_pop(target) * count(*)), 6) AS r2"


@query(f"SELECT fold, {_METRICS} FROM (SELECT * FROM oof WHERE abs_error IS NOT NULL) GROUP BY fold")
def persistence_metrics_by_fold(spark, d):
    return out_of_fold(spark, d).groupBy("fold").agg(*ev.metrics("target", "prediction")).select("fold", "n", _r("mae", 3), _r("rmse", 3), _r("r2"))


@query("SELECT 'persistence' AS model, round(avg(mae), 2) AS mae_mean, round(stddev_pop(mae), 2) AS mae_std, round(avg(rmse), 2) AS rmse_mean, round(stddev_pop(rmse), 2) AS rmse_std, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std FROM (SELECT fold, avg(abs_error) AS mae, sqrt(avg(abs_error * abs_error)) AS rmse, 1 - sum(abs_error * abs_error) / (var_pop(target) * count(*)) AS r2 FROM oof WHERE abs_error IS NOT NULL GROUP BY fold)")
def fold_summary(spark, d):
    per = out_of_fold(spark, d).groupBy("fold").agg(*ev.metrics("target", "prediction")).withColumn("model", F.lit("persistence"))
    return ev.fold_summary(per, "model").select("model", *[_r(f"{m}_{s}", n) for m, n in (("mae", 2), ("rmse", 2), ("r2", 6)) for s in ("mean", "std")])


def _by(dimension: str, expression: str):
    sql = f"SELECT {dimension}, round(avg(abs_error), 3) AS mae, count(*) AS n FROM (SELECT {expression} AS {dimension}, abs_error FROM oof) WHERE {dimension} IS NOT NULL AND abs_error IS NOT NULL GROUP BY 1"

    def run(spark, d):
        rows = ev.error_dimensions(out_of_fold(spark, d))
        rows = ev.value_level(rows, "target") if dimension == "level" else rows
        return ev.error_by(rows, dimension).select(dimension, _r("mae", 3), "n")

    run.__name__ = f"error_by_{dimension}"
    query(sql)(run)


_BANDS = " ".join(f"WHEN lat <= {b} THEN '({a}, {b}]'" for a, b in zip(range(-90, 91, 20), range(-70, 91, 20), strict=False))
_by("climate_zone", "CASE WHEN abs(lat) <= -0.01 THEN NULL WHEN abs(lat) <= 23.5 THEN 'tropical' WHEN abs(lat) <= 66.5 THEN 'temperate' WHEN abs(lat) <= 90 THEN 'polar' END")
_by("lat_band", f"CASE WHEN lat <= -90 THEN NULL {_BANDS} END")
_by("season", "CASE WHEN lat >= 0 THEN ['winter', 'spring', 'summer', 'autumn'] ELSE ['summer', 'autumn', 'winter', 'spring'] END[month(time) % 12 // 3 + 1]")
_by("horizon", "CASE WHEN months_since_observed IS NOT NULL THEN least(months_since_observed, 8) END")
_by("level", "CASE WHEN target <= (SELECT quantile_cont(target, 0.2) FROM oof) THEN 'very low' WHEN target <= (SELECT quantile_cont(target, 0.4) FROM oof) THEN 'low' WHEN target <= (SELECT quantile_cont(target, 0.6) FROM oof) THEN 'mid' WHEN target <= (SELECT quantile_cont(target, 0.8) FROM oof) THEN 'high' ELSE 'very high' END")


_PARTS = {
    "climate_zone": "CASE WHEN abs(lat) <= -0.01 THEN NULL WHEN abs(lat) <= 23.5 THEN 'tropical' WHEN abs(lat) <= 66.5 THEN 'temperate' WHEN abs(lat) <= 90 THEN 'polar' END",
    "lat_band": f"CASE WHEN lat <= -90 THEN NULL {_BANDS} END",
    "season": "CASE WHEN lat >= 0 THEN ['winter', 'spring', 'summer', 'autumn'] ELSE ['summer', 'autumn', 'winter', 'spring'] END[month(time) % 12 // 3 + 1]",
    "horizon": "CAST(CASE WHEN months_since_observed IS NOT NULL THEN least(months_since_observed, 8) END AS VARCHAR)",
    "level": "CASE WHEN target <= q[1] THEN 'very low' WHEN target <= q[2] THEN 'low' WHEN target <= q[3] THEN 'mid' WHEN target <= q[4] THEN 'high' ELSE 'very high' END",
}


@query(", q AS (SELECT quantile_cont(target, [0.2, 0.4, 0.6, 0.8]) AS q FROM oof), parts AS (SELECT abs_error, " + ", ".join(f"{e} AS {d}" for d, e in _PARTS.items()) + " FROM oof, q WHERE abs_error IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, round(avg(abs_error), 3) AS mae, count(*) AS n FROM parts WHERE {d} IS NOT NULL GROUP BY {d}" for d in _PARTS))
def error_breakdowns(spark, d):
    """All five breakdowns of the error from one scan and one aggregate."""
    rows = ev.value_level(ev.error_dimensions(out_of_fold(spark, d)), "target")
    return ev.error_breakdowns(rows).select("dimension", "value", _r("mae", 3), "n")


@query("SELECT fold, count(*) FILTER (WHERE masked) AS n_masked, round(avg(abs_error) FILTER (WHERE masked), 3) AS mae_masked, round(avg(abs_error) FILTER (WHERE NOT masked), 3) AS mae_seen FROM oof GROUP BY fold")
def masked_vs_unmasked_error(spark, d):
    e = lambda w: F.round(F.avg(F.when(w, F.col("abs_error"))), 3)
    return out_of_fold(spark, d).groupBy("fold").agg(F.count_if("masked").alias("n_masked"), e(F.col("masked")).alias("mae_masked"), e(~F.col("masked")).alias("mae_seen"))


# --- ensembles: members are the forecast with an offset of their own
_MEMBERS = ", mem AS (SELECT lat, lon, time, target, fold, CAST(member AS INTEGER) AS member, prediction + (member - 3) * 1000 * (1 + (CAST(floor(lat + lon) AS BIGINT) % 3 + 3) % 3) AS prediction FROM oof, range(7) AS r(member) WHERE prediction IS NOT NULL)"
_CURVE = ", cur AS (SELECT fold, member + 1 AS n_models, target, avg(prediction) OVER (PARTITION BY lat, lon, time ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prediction FROM mem), per AS (SELECT fold, n_models, avg(abs(target - prediction)) AS mae FROM cur GROUP BY 1, 2), agg AS (SELECT CAST(n_models AS INTEGER) AS n_models, avg(mae) AS mae, stddev_samp(mae) AS std FROM per GROUP BY 1)"


def _members(spark, d):
    rows = out_of_fold(spark, d).where("prediction IS NOT NULL").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select(*ID, "target", "fold", "member", F.expr("prediction + (member - 3) * 1000 * (1 + (CAST(floor(lat + lon) AS BIGINT) % 3 + 3) % 3)").alias("prediction"))


def _curve(spark, d):
    per = ev.ensemble_curve(_members(spark, d), *ID).groupBy("fold", "n_models").agg(*ev.metrics("target", "prediction"))
    return per.groupBy("n_models").agg(F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("std"))


@query(_MEMBERS + " SELECT lat, lon, time, round(avg(prediction), 4) AS prediction, count(*) AS members FROM mem GROUP BY 1, 2, 3")
def ensemble_mean(spark, d):
    return ev.ensemble_mean(_members(spark, d), *ID).select(*ID, _r("prediction", 4), "members")


@query(_MEMBERS + _CURVE + " SELECT n_models, round(mae, 3) AS mae, round(std, 3) AS std FROM agg")
def ensemble_cumulative_curve(spark, d):
    return _curve(spark, d).select("n_models", _r("mae", 3), _r("std", 3))


@query(_MEMBERS + _CURVE + " SELECT (SELECT n_models FROM agg ORDER BY mae, n_models LIMIT 1) AS best, min(n_models) AS enough FROM agg WHERE mae <= 1.01::DOUBLE * (SELECT min(mae) FROM agg)")
def best_member_count(spark, d):
    return ev.best_member_count(_curve(spark, d))


@query("SELECT strftime(t.time, '%Y%m%d') || '_' || CAST(CAST(t.lat * 10 AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(t.lon AS INTEGER) AS VARCHAR) AS id, o.prediction FROM panel t LEFT JOIN o ON o.lat = t.lat AND o.lon = t.lon AND o.time = t.time WHERE NOT t.is_train")
def template_left_join(spark, d):
    key = F.concat_ws("_", F.date_format("time", "yyyyMMdd"), (F.col("lat") * 10).cast("int"), F.col("lon").cast("int")).alias("id")
    return ev.template_join(panel(spark, d).where("NOT is_train").select(key), observed(spark, d).select(key, "prediction"), "id")


@query("SELECT time, sum(v) AS total FROM raw GROUP BY time ORDER BY total DESC, time LIMIT 10")
def top_months(spark, d):
    return table_totals(spark, d).orderBy(F.desc("total"), "time").limit(10)


def table_totals(spark, d):
    return src.table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("time")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("total"))


# --- all features
_ALL = f""", d AS (SELECT *, {", ".join(f"lag(value, {k}) {W} AS value_lag{k}" for k in (1, 3, 6, 12))}, {", ".join(f"avg(value) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS value_rollmean{n}" for n in (3, 6, 12))},
    {", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" for c in PANEL.covariates for k in (1, 3))},
    CASE WHEN row_number() OVER (PARTITION BY lat, lon, month(time) ORDER BY time) > 1 THEN count(value) {_S} END AS climatology_count, value - climatology_mean AS anomaly FROM o),
    f AS (SELECT *, value - value_lag1 AS value_diff1, value - value_lag12 AS value_diff12 FROM d),
    near AS ({_NEAR})
    """
_ALL_SELECT = f"""SELECT f.lat, f.lon, f.time, f.value, f.cov_quantity, f.cov_discount, f.cov_count, f.masked, f.is_train, f.target, value_lag1, value_lag3, value_lag6, value_lag12, value_rollmean3, value_rollmean6, value_rollmean12,
    climatology_mean, climatology_count, anomaly, last_observed, months_since_observed, {", ".join(f"{c}_lag{k}" for c in PANEL.covariates for k in (1, 3))}, value_diff1, value_diff12, {_TREND.replace("PARTITION BY lat, lon ORDER BY time", "PARTITION BY f.lat, f.lon ORDER BY f.time")},
    {", ".join(f"{s}_{c}" for s in ne.SIDES for c in ne.CARRIED)}, round(sin(2 * pi() * month(f.time + INTERVAL 1 MONTH) / 12), 6) + 0.0 AS target_month_sin, round(cos(2 * pi() * month(f.time + INTERVAL 1 MONTH) / 12), 6) + 0.0 AS target_month_cos
    FROM f JOIN near ON f.lat = near.lat AND f.lon = near.lon AND f.time = near.time"""


@query(_ALL + _ALL_SELECT)
def full_feature_pipeline(spark, d):
    rows = build_features(panel(spark, d), gap=GAP, cells=src.supplier_cells(spark, d))
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("target_month_sin", "target_month_cos")})


# --- models
@query("SELECT lat, lon, time, coalesce(value::DOUBLE, (SELECT quantile_cont(value, 0.5) FROM g WHERE is_train)::DOUBLE) AS value FROM g")
def median_impute(spark, d):
    rows = gapped(spark, d)
    return ev.median_impute(rows.where("is_train"), rows, "value").select(*ID, "value")


@query("SELECT lat, lon, time, round((value - m) / s, 6) AS value FROM g, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM g WHERE is_train)")
def standard_scaling(spark, d):
    rows = gapped(spark, d)
    return ev.standardise(rows.where("is_train"), rows, "value").select(*ID, _r("value"))


MODEL_FEATURES = ["value", "last_observed", "months_since_observed", "climatology_mean"]


def _model_rows(spark, d):
    rows = observed(spark, d).where("is_train AND target IS NOT NULL")
    return fo.with_time_folds(rows, fo.temporal_holdout(panel(spark, d).where("is_train"), 0.2))


@query()
def gbt_fit_predict(spark, d):
    rows = _model_rows(spark, d)
    return fc.fit_predict(rows.where("role = 'fit'"), rows.where("role = 'val'"), MODEL_FEATURES)[0].select(*ID, "target", "prediction")


@query("SELECT lat, lon, time, value FROM panel ORDER BY md5('42|' || CAST(lat * 10 AS INTEGER) || '|' || CAST(lon AS INTEGER) || '|' || strftime(time, '%Y-%m-%d')) LIMIT 500")
def seeded_sample(spark, d):
    place = F.md5(F.concat_ws("|", F.lit("42"), (F.col("lat") * 10).cast("int"), F.col("lon").cast("int"), F.date_format("time", "yyyy-MM-dd")))
    return panel(spark, d).select(*ID, "value").orderBy(place).limit(500)


_MD5 = "md5('{}|' || CAST(lat AS VARCHAR) || '|' || CAST(lon AS VARCHAR) || '|' || strftime(time, '%Y-%m-%d'))"


@query(f"""SELECT a.lat, a.lon, a.time, b.value FROM (SELECT *, row_number() OVER (ORDER BY {_MD5.format(7)}) AS k FROM panel) a
    JOIN (SELECT value, row_number() OVER (ORDER BY {_MD5.format(8)}) AS k FROM panel) b ON a.k = b.k""")
def permuted_values(spark, d):
    """The value column dealt anew over the whole panel."""
    return fc.permuted(panel(spark, d).select(*ID, "value"), ["value"], ID, 7).select(*ID, "value")


# --- checked, committed and listed tables
@query("""SELECT * FROM (SELECT 'rows' AS rule, count(*) AS n FROM panel UNION ALL SELECT 'no_key', 0 UNION ALL SELECT 'flag_and_value', count(*) FILTER (WHERE masked <> (value IS NULL)) FROM g
    UNION ALL SELECT 'target_on_test', count(*) FILTER (WHERE NOT is_train AND target IS NOT NULL) FROM g UNION ALL SELECT 'horizon_range', count(*) FILTER (WHERE months_since_observed < 1 OR months_since_observed > 600) FROM o
    UNION ALL SELECT 'horizon_without_value', count(*) FILTER (WHERE (months_since_observed IS NULL) <> (last_observed IS NULL)) FROM o)""")
def checked_features(spark, d):
    """What the rules counted while the features were written; a broken one would have stopped the commit."""
    rows = build_features(panel(spark, d), gap=GAP, cells=src.supplier_cells(spark, d))
    found = src.checked_write(rows, shared(spark, "checked"), src.feature_rules())
    return spark.createDataFrame(list(found.items()), "rule string, n long")


@query(f"SELECT 'persistence' AS run, fold, {_METRICS} FROM (SELECT * FROM oof WHERE abs_error IS NOT NULL) GROUP BY fold")
def run_table(spark, d):
    """The table of runs after a run that was repeated: it stands there once."""
    path = shared(spark, "runs")
    rows = persistence_metrics_by_fold(spark, d)
    src.append_run(rows, path, "persistence")
    src.append_run(rows, path, "persistence")
    return spark.read.parquet(path).select("run", "fold", "n", "mae", "rmse", "r2")


_LISTED = ["value", "cov_quantity", "cov_discount", "cov_count", *[f"value_lag{k}" for k in (1, 3, 6, 12)], *[f"value_rollmean{k}" for k in (3, 6, 12)], "climatology_mean", "climatology_count", "anomaly", "last_observed", "months_since_observed",
    *[f"{c}_lag{k}" for c in PANEL.covariates for k in (1, 3)], "value_diff1", "value_diff12", *[f"value_diff{k}_trend_{m}" for k in (1, 12) for m in ("mean", "count")], *[f"{x}_{c}" for x in ne.SIDES for c in ne.CARRIED], "target_month_sin", "target_month_cos"]


def _listed_sql() -> str:
    whole = [n for n in _LISTED if n != "cov_count"]
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variant, {k} AS place, '{n}' AS name, (SELECT count({n}) FROM feats) AS known" for v in VARIANTS for k, n in enumerate(variant(whole, v)))
    return f"{_ALL}, feats AS ({_ALL_SELECT}) {rows}"


@query(_listed_sql())
def feature_variants(spark, d):
    """Named sets of features from the manifest that stands beside the stored table, less one that is excluded, and how many rows know each."""
    path = shared(spark, "features")
    rows = build_features(panel(spark, d), gap=GAP, cells=src.supplier_cells(spark, d))
    src.write_features(rows, path, feature_columns(rows, not_features()))
    names = src.read_manifest(spark, path, exclude=("cov_count",))
    known = spark.read.parquet(f"{path}/features.parquet").agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "name", "known")
    listed = [(v, k, n) for v in VARIANTS for k, n in enumerate(variant(names, v))]
    return spark.createDataFrame(listed, "variant string, place int, name string").join(F.broadcast(known), "name").select("variant", "place", "name", "known")  # a row a column


# --- experiments
_OBSERVED = {"persistence": "coalesce(CAST(last_observed AS DOUBLE), climatology_mean)", "climatology": "coalesce(climatology_mean, CAST(last_observed AS DOUBLE))"}
#: Forecasts that need no training, by name: a column of the observed panel.
BASELINES = {name: F.expr for name in _OBSERVED}
#: What judges a model, by name: a function of the observed panel that gives rows with a fold.
SCHEMES = {
    "temporal": lambda rows, whole: fo.with_time_folds(rows, fo.temporal_folds(whole.where("is_train"), 5).where("role = 'val'")).drop("role"),
    "spatial": lambda rows, whole: fo.with_space_folds(rows, fo.spatial_folds(whole, 5, 4.0), 4.0),
}
_ERRORS = "count(*) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - sum(e * e) / (var_pop(target) * count(*)), 6) AS r2"
_JUDGED = ", " + SPATIAL + f""", judged AS (SELECT o.*, 'temporal' AS scheme, CAST(folds.fold AS INTEGER) AS fold FROM o JOIN folds ON o.time = folds.time AND role = 'val' WHERE target IS NOT NULL
    UNION ALL SELECT o.*, 'spatial', sr.fold FROM o JOIN sr ON sr.block = CAST(floor(lat / 4) AS INTEGER) || '_' || CAST(floor(lon / 4) AS INTEGER) WHERE target IS NOT NULL),
    both_ AS ({" UNION ALL ".join(f"SELECT scheme, fold, '{name}' AS model, target, target - {sql} AS e, months_since_observed FROM judged" for name, sql in _OBSERVED.items())}),
    per AS (SELECT scheme, model, fold, {_ERRORS} FROM both_ WHERE e IS NOT NULL GROUP BY 1, 2, 3)"""


def _judged(spark, d):
    rows, whole, out = observed(spark, d).where("target IS NOT NULL"), panel(spark, d), None
    for scheme, split in SCHEMES.items():
        parts = split(rows, whole).withColumn("scheme", F.lit(scheme))
        own = parts.select("scheme", "fold", *ID, "target", "months_since_observed", *[BASELINES[m](sql).alias(m) for m, sql in _OBSERVED.items()])
        out = own if out is None else out.unionByName(own)
    return out.unpivot(["scheme", "fold", *ID, "target", "months_since_observed"], list(_OBSERVED), "model", "prediction")


@query(_JUDGED + " SELECT * FROM per")
def baselines_by_scheme(spark, d):
    """Each baseline under temporal and spatial folds: one plan, one aggregate."""
    per = _judged(spark, d).groupBy("scheme", "model", "fold").agg(*ev.metrics("target", "prediction"))
    return per.select("scheme", "model", "fold", "n", _r("mae", 3), _r("rmse", 3), _r("r2"))


@query(_JUDGED + f", whole AS (SELECT scheme, model, {_ERRORS} FROM both_ WHERE e IS NOT NULL GROUP BY 1, 2) SELECT a.scheme, a.model, round(a.mae - b.mae, 2) AS mae_gain, round(a.rmse - b.rmse, 2) AS rmse_gain, round(a.r2 - b.r2, 5) AS r2_gain FROM whole a JOIN whole b ON a.scheme = b.scheme AND b.model = 'persistence' WHERE a.model <> 'persistence'")
def baseline_gains(spark, d):
    whole = _judged(spark, d).groupBy("scheme", "model").agg(*ev.metrics("target", "prediction"))
    return ev.metric_gains(whole, "model", "persistence", "scheme").select("scheme", "model", _r("mae_gain", 2), _r("rmse_gain", 2), _r("r2_gain", 5))


@query("SELECT round(avg(abs_error), 3) AS mae, count(abs_error) AS n FROM oof")
def overall_error(spark, d):
    return out_of_fold(spark, d).agg(F.round(F.avg("abs_error"), 3).alias("mae"), F.count("abs_error").alias("n"))


#: Members of an ensemble: a seed and a factor of the outage rates each.
MEMBERS = [(42 + k, f) for k, f in enumerate(ou.multipliers(0.5, 2.0, 4))]


def _member_sql(where: str) -> str:
    """The climatology of each member's masked panel beside what is observed on the plain one."""
    parts = [
        f"SELECT {k} AS member, lat, lon, time, is_train, target, last, avg(v) {_S} AS clim FROM (SELECT *, CASE WHEN is_train AND time IN ({_drawn(seed, factor) or 'NULL'}) THEN NULL ELSE value END AS v FROM plain)"
        for k, (seed, factor) in enumerate(MEMBERS)
    ]
    return f""", plain AS (SELECT *, last_value(CASE WHEN NOT masked THEN value END IGNORE NULLS) OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM panel),
    every AS ({" UNION ALL ".join(parts)}), mem AS (SELECT CAST(member AS INTEGER) AS member, lat, lon, time, target, 0.5 * last + 0.5 * clim AS prediction FROM every WHERE {where} AND last IS NOT NULL AND clim IS NOT NULL)"""


def _drawn_members(spark, d):
    """(member, cell, time, target, prediction): the last value of the plain history, mixed with the climatology of a member's own masked panel."""
    import numpy as np

    rows = panel(spark, d)
    months = ou.train_months(rows)
    gaps = {k: ou.draw_months(months, ou.scaled(RATES, factor), np.random.default_rng(seed)) for k, (seed, factor) in enumerate(MEMBERS)}
    rows = rows.withColumn("last", hi.last_observed()["last_observed"])
    drawn, spec = ou.many_draws(rows, gaps)
    drawn = drawn.withColumn("clim", hi.climatology(spec)["climatology_mean"]).withColumnRenamed("draw", "member")
    return drawn.withColumn("prediction", 0.5 * F.col("last") + 0.5 * F.col("clim"))


_FINAL = _member_sql("NOT is_train").replace("0.5 * clim AS prediction", "0.5 * coalesce(clim, last) AS prediction").replace(" AND clim IS NOT NULL", "")


@query(_FINAL + " SELECT strftime(time, '%Y%m%d') || '_' || CAST(CAST(lat * 10 AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(lon AS INTEGER) AS VARCHAR) AS \"ID\", printf('%.2f', round(avg(prediction), 6)) AS target FROM mem GROUP BY lat, lon, time")
def final_predictions(spark, d):
    """The predictions file of formula members: from the cache, their mean, joined one to one to a template of the panel's test rows, written as one file and read back as text.

    Every test row must have a prediction, or the join stops the job: a cell without a climatology takes its last value.
    """
    path = shared(spark, "final")
    key = F.concat_ws("_", F.date_format("time", "yyyyMMdd"), (F.col("lat") * 10).cast("int"), F.col("lon").cast("int")).alias("ID")
    members = _drawn_members(spark, d).where("NOT is_train").select("member", key, (0.5 * F.col("last") + 0.5 * F.coalesce("clim", "last")).alias("prediction"))
    template = panel(spark, d).where("NOT is_train").select(key)
    out = None
    for k, (seed, factor) in enumerate(MEMBERS):
        own = src.member_predictions(spark, f"{path}/members", seed, factor, lambda k=k: members.where(F.col("member") == k).drop("member"), template)
        out = own if out is None else out.unionByName(own)
    means = ev.ensemble_mean(out, "ID").withColumn("prediction", F.round("prediction", 6))
    src.write_predictions(ev.template_join(template.withColumn("place", F.col("ID")), means, "ID").withColumnRenamed("prediction", "Target"), f"{path}/predictions.csv")
    return src.scan_csv(spark, f"{path}/predictions.csv", "ID string, Target string").withColumnRenamed("Target", "target")


_HORIZON = _member_sql("is_train AND target IS NOT NULL") + ", mh AS (SELECT m.member, CASE WHEN o.months_since_observed > 1 THEN 'later' ELSE 'next' END AS horizon, abs(m.target - m.prediction) AS e FROM mem m JOIN o ON o.lat = m.lat AND o.lon = m.lon AND o.time = m.time)"


@query(_HORIZON + " SELECT member, horizon, round(avg(e), 3) AS mae, count(*) AS n FROM mh GROUP BY 1, 2")
def member_by_horizon(spark, d):
    """Each member's error at short and longer horizons of one fixed reference mask."""
    rows = _drawn_members(spark, d).where("is_train AND target IS NOT NULL AND prediction IS NOT NULL").select("member", *ID, F.abs(F.col("target") - F.col("prediction")).alias("e"))
    horizon = observed(spark, d).select(*ID, F.when(F.col("months_since_observed") > 1, "later").otherwise("next").alias("horizon"))
    return rows.join(horizon, ID).groupBy("member", "horizon").agg(F.round(F.avg("e"), 3).alias("mae"), F.count("*").alias("n"))


@query(_member_sql("is_train AND target IS NOT NULL") + " SELECT CASE WHEN member < 2 THEN 'low' ELSE 'high' END AS rates, round(avg(e), 3) AS mae, count(*) AS n FROM (SELECT *, abs(target - prediction) AS e FROM mem) GROUP BY 1")
def rate_range_comparison(spark, d):
    """The error of members by the range of their outage rates."""
    rows = _drawn_members(spark, d).where("is_train AND target IS NOT NULL AND prediction IS NOT NULL")
    return rows.groupBy(F.when(F.col("member") < 2, "low").otherwise("high").alias("rates")).agg(F.round(F.avg(F.abs(F.col("target") - F.col("prediction"))), 3).alias("mae"), F.count("*").alias("n"))


_BESIDE = [f"{s}_last_observed" for s in ne.SIDES]


@query(f", near AS ({_NEAR}), nf AS (SELECT o.target, o.last_observed AS own, list_avg(list_filter([o.last_observed, {', '.join(f'near.{c}' for c in _BESIDE)}], lambda x: x IS NOT NULL)) AS wide FROM o JOIN near ON o.lat = near.lat AND o.lon = near.lon AND o.time = near.time WHERE o.is_train AND o.target IS NOT NULL AND o.last_observed IS NOT NULL) SELECT round(avg(abs(target - own)), 3) AS mae_alone, round(avg(abs(target - wide)), 3) AS mae_with, round(avg(abs(target - wide)) - avg(abs(target - own)), 2) AS gain FROM nf")
def neighbour_gain(spark, d):
    """What the neighbours' last observations add to a cell's own."""
    rows = ne.add_neighbours(observed(spark, d), cells=src.supplier_cells(spark, d)).where("is_train AND target IS NOT NULL AND last_observed IS NOT NULL")
    seen = F.filter(F.array("last_observed", *_BESIDE), lambda x: x.isNotNull())
    wide = F.aggregate(seen, F.lit(0).cast("double"), lambda a, x: a + x) / F.size(seen)
    a, b = F.avg(F.abs(F.col("target") - F.col("last_observed"))), F.avg(F.abs(F.col("target") - wide))
    return rows.agg(F.round(a, 3).alias("mae_alone"), F.round(b, 3).alias("mae_with"), F.round(b - a, 2).alias("gain"))


@query()
def network_forecast(spark, d):
    """A network with a new outage draw each epoch, stopped by an inner holdout of months, judged on the unmasked months after it.

    The unmasked features are stored once, in buckets of cells; an epoch computes only what its draw's months touch, where they lie.
    """
    import numpy as np

    path = shared(spark, "network")
    panel(spark, d).where("is_train").write.parquet(f"{path}/panel")
    rows = spark.read.parquet(f"{path}/panel")
    whole = rd.store_by_cell(fo.with_time_folds(rows, fo.two_tier_split(rows)), rows.count(), f"{path}/features")
    months = ou.train_months(whole.where("role = 'fit'"))

    def draw(epoch):
        gap = ou.draw_months(months, RATES, np.random.default_rng(42 + epoch))
        return rd.many_redrawn(whole, {0: gap}).where("role = 'fit'")

    names = [c for c in feature_columns(whole, not_features()) if c != "role" and not c.startswith("_")]
    fitted = nw.fit_network(draw, whole.where("role = 'inner_val'"), names, hidden=(64, 32), epochs=10, patience=3, rate=2e-3)
    return fitted.predict(whole.where("role = 'outer_val' AND target IS NOT NULL")).select(*ID, "target", "prediction")


# --- arrivals
@query("SELECT user_id, CAST(ts AS DATE) AS time, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_daily_sums(spark, d):
    """The events table as a stream, fed through to its end."""
    path = shared(spark, "stream")
    schema = src.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals.run_to_end(arrivals.daily_sums(stream, "ts", "user_id", "value"), path)
    return arrivals.latest(spark, path, "user_id", "time")


from . import experiments  # noqa: E402, F401 - registers its queries

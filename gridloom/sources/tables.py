"""Scans and sinks: raw CSV and Parquet tables, panels made of business tables, prediction files and caches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index, two_decimals
from ..operators.panel import PANEL, PanelSpec

#: Columns of the raw train file; the test file has no target and a mask flag instead.
RAW = "time date, lat double, lon double, TWS_t double, SPEI_01_t double, SPEI_03_t double, SPEI_06_t double, SPEI_12_t double, SOIL_MOISTURE_t double, month_sin double, month_cos double"
TRAIN_SCHEMA, TEST_SCHEMA = f"sample_id string, {RAW}, target double", f"ID string, {RAW}, TWS_t_masked boolean"
RAW_SPEC = PanelSpec(value="TWS_t", covariates=("SPEI_01_t", "SPEI_03_t", "SPEI_06_t", "SPEI_12_t", "SOIL_MOISTURE_t"), masked="TWS_t_masked")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, its schema given, its id column named ID."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumnRenamed("sample_id", "ID") if "ID" not in df.columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def _as_panel(monthly: DataFrame, cut: str, every: int = 5) -> DataFrame:
    """Adds flags, masks the value of every ``every``-th test month, and takes the next calendar month's value as target."""
    steps = Window.partitionBy("lat", "lon").orderBy("time")
    train = F.col("time") < F.lit(cut).cast("date")
    masked = ~train & (month_index(F.col("time")) % every == 2)
    follows = F.lead("time").over(steps) == F.add_months("time", 1)
    target = F.when(train & follows, F.lead("v").over(steps))
    rest = [c for c in monthly.columns if c.startswith("cov_")]
    return monthly.select("lat", "lon", "time", F.when(~masked, F.col("v")).alias("value"), *rest, masked.alias("masked"), train.alias("is_train"), target.alias("target"))


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cells; value: cents sold a month. Each ten share one of 180 latitudes, which are spread over both hemispheres."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.expr("l_suppkey div 10")
    lat, lon = (row * 67 % 180 - 89.5).cast("double"), (F.col("l_suppkey") % 10 + F.expr("l_suppkey div 1800") * 10).cast("double")
    key = [lat.alias("lat"), lon.alias("lon"), F.trunc("l_shipdate", "MM").alias("time")]
    monthly = lines.groupBy(*key).agg(_cents("l_extendedprice").alias("v"), F.sum(F.round("l_quantity").cast("long")).alias("cov_quantity"), _cents("l_discount").alias("cov_discount"), F.count("*").alias("cov_count"))
    return _as_panel(monthly, "2000-01-01")


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``supplier_month``, from one column of the lines."""
    row = F.expr("l_suppkey div 10")
    lat, lon = (row * 67 % 180 - 89.5).cast("double"), (F.col("l_suppkey") % 10 + F.expr("l_suppkey div 1800") * 10).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(lat.alias("lat"), lon.alias("lon"))


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cells of a grid five wide; value: cents ordered a month."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key = [F.floor(F.col("c_nationkey") / 5).cast("double").alias("lat"), (F.col("c_nationkey") % 5).cast("double").alias("lon"), F.trunc("o_orderdate", "MM").alias("time")]
    return _as_panel(orders.groupBy(*key).agg(_cents("o_totalprice").alias("v"), F.count("*").alias("cov_count")), "2000-01-01")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cells; value: cents a day of January 2024. Its steps are days, so only row-step features apply."""
    events = table(spark, sf_dir, "events")
    key = [F.floor(F.col("user_id") / 10).cast("double").alias("lat"), (F.col("user_id") % 10).cast("double").alias("lon"), F.to_date("ts").alias("time")]
    return events.groupBy(*key).agg(_cents("value").alias("value"), F.count("*").alias("cov_count"))


def files(spark: SparkSession, path: str):
    """(the file system of a path, a function from text to its path objects)."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), made


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file."""
    fs, at = files(spark, path)
    out = fs.create(at(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, at = files(spark, path)
    if not fs.exists(at(path)):
        return None
    stream = fs.open(at(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def moved(spark: SparkSession, staged: str, path: str) -> None:
    """A staged file or folder takes the place of what is at ``path``: one rename, after what was there is gone."""
    fs, at = files(spark, path)
    fs.mkdirs(at(path).getParent())
    fs.delete(at(path), True)
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"{staged} could not be moved to {path}")


class BrokenRule(ValueError):
    """Rows that were to be written break a rule."""


def feature_rules(spec: PanelSpec = PANEL, longest: int = 600) -> dict[str, Column]:
    """What rows of features must not be, by name."""
    horizon = F.col("months_since_observed")
    return {
        "no_key": F.col(spec.keys[0]).isNull() | F.col(spec.keys[1]).isNull() | F.col(spec.time).isNull(),
        "flag_and_value": spec.is_masked() != F.col(spec.value).isNull(),
        "target_on_test": ~F.col(spec.train) & F.col(spec.target).isNotNull(),
        "horizon_range": horizon.isNotNull() & ~horizon.between(1, longest),
        "horizon_without_value": horizon.isNull() != F.col("last_observed").isNull(),
    }


def checked_write(df: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Writes ``df`` as Parquet unless a row breaks a rule (a column that is true there); gives the rows seen and broken.

    The rules are counted while the rows flow to a staged table, so nothing is scanned twice; only a sound table moves to
    ``path``. A task that ran twice can count a broken row twice, but never miss one.
    """
    spark, watch, staged = df.sparkSession, Observation(), f"{path}._staged-{uuid.uuid4().hex}"
    counts = [F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()]
    df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts).write.parquet(staged)
    found = dict(watch.get)
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if broken:
        fs, at = files(spark, staged)
        fs.delete(at(staged), True)
        raise BrokenRule(f"rows that break a rule: {broken}")
    moved(spark, staged, path)
    return found


def fingerprint(keys: DataFrame | None, *settings: object) -> str:
    """A digest of a table's rows, whatever their order, and of settings."""
    text = [str(x) for x in settings]
    if keys is not None:
        row = keys.agg(F.count("*"), F.sum(F.xxhash64(*keys.columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *keys.columns).cast("decimal(38,0)"))).first()
        text += [*keys.columns, *map(str, row)]
    return hashlib.sha256("\n".join(text).encode()).hexdigest()


def commit_once(df: Callable[[], DataFrame] | DataFrame, path: str, mark: str, sound: Callable[[DataFrame], bool] | None = None) -> bool:
    """Writes a table to ``path`` unless one with the same ``mark`` (a fingerprint) that is ``sound`` stands there; says whether it wrote.

    The rows go to a staged folder with the mark beside them, and one rename commits both, so a job that was killed leaves
    nothing that is read, and one that is repeated writes nothing twice.
    """
    frame = df if isinstance(df, DataFrame) else None
    spark = frame.sparkSession if frame is not None else SparkSession.active()
    if read_text(spark, f"{path}/_mark") == mark and (sound is None or sound(spark.read.parquet(path))):
        return False
    staged = f"{path}._staged-{uuid.uuid4().hex}"
    (frame if frame is not None else df()).write.parquet(staged)
    write_text(spark, f"{staged}/_mark", mark)
    moved(spark, staged, path)
    return True


def write_features(df: DataFrame, path: str, names: list[str]) -> None:
    """Features as Parquet, and their names in order as a one-column table beside it."""
    df.write.mode("overwrite").parquet(f"{path}/features.parquet")
    rows = [(i, n) for i, n in enumerate(names)]
    df.sparkSession.createDataFrame(rows, "place int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")


def read_manifest(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """The feature names that ``write_features`` left beside a table, in order, less ``exclude``."""
    rows = spark.read.schema("place int, name string").json(f"{path}/manifest.json").collect()  # a row a column
    return [r.name for r in sorted(rows) if r.name not in exclude]


def write_predictions(template: DataFrame, path: str, order: str = "place", key: str = "ID", value: str = "Target") -> None:
    """One CSV file of two-decimal predictions in the template's order, with one header and LF line ends.

    Tasks write sorted ranges; the committer appends their bytes in order to one file, a buffer at a time, and moves it to
    ``path``. A value that has no two decimals, such as NaN, stops the job before that.
    """
    spark, staged = template.sparkSession, f"{path}._staged-{uuid.uuid4().hex}"
    out = template.repartitionByRange(order).sortWithinPartitions(order).select(key, two_decimals(value).alias(value))
    out.write.option("header", False).option("lineSep", "\n").csv(f"{staged}/parts")
    fs, at = files(spark, staged)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(at(f"{staged}/parts")) if s.getPath().getName().startswith("part-"))
    sink = fs.create(at(f"{staged}/file"), True)
    sink.write(bytearray(f"{key},{value}\n".encode()))
    for part in parts:
        stream = fs.open(at(part))
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 1 << 16, False)
        stream.close()
    sink.close()
    moved(spark, f"{staged}/file", path)
    fs.delete(at(staged), True)


def member_predictions(spark: SparkSession, path: str, seed: int, multiplier: float, make, ids: DataFrame | None = None, model: str = "") -> DataFrame:
    """A member's predictions from the cache, or made, committed and read back. Rows are matched by key, so order doesn't matter.

    A cache that holds other keys than ``ids``, or is of another ``model`` (a text that tells its settings), is made anew.
    """
    own = f"{path}/seed={seed}/multiplier={multiplier}"
    same = None if ids is None else lambda held: fingerprint(held.select(*ids.columns)) == fingerprint(ids)
    commit_once(make, own, fingerprint(None, seed, multiplier, model), same)
    return spark.read.parquet(own)


def read_settings(path: str) -> dict:
    """A YAML file of lags, windows, rates and paths."""
    import yaml

    with open(path) as file:
        return yaml.safe_load(file) or {}


def write_report(df: DataFrame, path: str, order: str | None = None) -> None:
    """A small table of metrics as one CSV file."""
    (df.orderBy(order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_if_possible(df: DataFrame, path: str) -> str | None:
    """Rows behind a report as Parquet; what goes wrong is returned as text, since the report already stands."""
    try:
        df.write.mode("overwrite").parquet(path)
    except Exception as error:
        return f"{type(error).__name__}: {error}"
    return None


def append_run(df: DataFrame, path: str, name: str, settings: str = "") -> bool:
    """Adds metric rows of a run to the table of runs, once: a repeated run of equal rows and settings adds none, another takes its place."""
    rows = df.withColumns({"settings": F.lit(settings), "at": F.current_timestamp()})
    return commit_once(rows, f"{path}/run={name}", fingerprint(df, name, settings))

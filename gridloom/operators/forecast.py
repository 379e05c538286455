"""Forecast models on the panel's features: MLlib's boosted trees with median imputation, permutation importance, what a model may see. Bags, folds and searches: ``boosting``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import imputed, medians, metrics
from .panel import PANEL, PanelSpec


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_predict(fit: DataFrame, val: DataFrame, features: list[str], spec: PanelSpec = PANEL, stop_column: str | None = None, **options) -> tuple[DataFrame, object]:
    """``val`` with predictions of trees fitted on ``fit`` (NULL features by the medians of ``fit``), and the model.

    ``stop_column`` marks rows of ``fit`` on which boosting stops early.
    """
    known = fit.drop("prediction").where(F.col(spec.target).isNotNull())
    model = GBTRegressor(featuresCol="features", labelCol=spec.target, predictionCol="prediction", **({"maxIter": 20, "maxDepth": 4, "seed": 42} | options))
    if stop_column:
        model = model.setValidationIndicatorCol(stop_column)
    middle = medians(known, *features)
    middle = known.sparkSession.createDataFrame(middle.collect(), middle.schema)  # one row, counted once
    ready = assembled(imputed(middle, known, *features).withColumn(spec.target, F.col(spec.target).cast("double")), features)
    fitted = model.fit(ready)
    return fitted.transform(assembled(imputed(middle, val.drop("prediction"), *features), features)).drop("features"), fitted


def projected(df: DataFrame, features: list[str], use_position: bool = False, spec: PanelSpec = PANEL) -> list[str]:
    """The columns that a model may see: the features that ``df`` has, and the coordinates only if asked for."""
    return [c for c in features if c in df.columns] + (list(spec.keys[-2:]) if use_position else [])


def placed(df: DataFrame, order: Column, ties: list[str], by: tuple[str, ...] = (), parts: int = 256, name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of a hexadecimal text, such as an md5; without one task that sorts all.

    The first four digits deal rows to ``parts`` ranges; a range's rows are sorted by themselves and its places start where
    those before end (a row a range is counted and sent back). Each value of ``by`` has an order of its own.
    """
    rows = df.withColumn("_o", order).withColumn("_part", F.floor(F.conv(F.substring("_o", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int"))
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))  # at most ``parts`` rows a value of ``by``
    own = Window.partitionBy(*by, "_part").orderBy("_o", *ties)
    return rows.withColumn("_k", F.row_number().over(own)).join(F.broadcast(starts), [*by, "_part"]).withColumn(name, F.col("_from") + F.col("_k") - 1).drop("_o", "_part", "_n", "_from", "_k")


def keyed_order(seed: int, *key: str) -> Column:
    """The md5 of a seed and a row's key: the order that a seed draws."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def permuted(df: DataFrame, columns: list[str], key: list[str], seed: int, by: tuple[str, ...] = (), parts: int = 256) -> DataFrame:
    """``df`` with the values of ``columns`` dealt anew over the whole table: the row at a place of one seeded order takes those of the row at that place of another.

    Rows of each value of ``by`` are dealt by themselves, in another way each. A value may land anywhere.
    """
    here = placed(df.drop(*columns), keyed_order(seed, *by, *key), key, by, parts, "_place")
    dealt = placed(df.select(*by, *key, *columns), keyed_order(seed + 1, *by, *key), key, by, parts, "_place").select(*by, "_place", *columns)
    return here.join(dealt, [*by, "_place"]).drop("_place")


def permutation_importance(predict: Callable[[DataFrame], DataFrame], val: DataFrame, features: list[str], key: list[str], spec: PanelSpec = PANEL, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance): the mean rise of the absolute error when a feature's values are dealt anew over the whole table.

    ``predict`` adds ``prediction`` to a table. ``val`` should be written: its rows are placed twice for each repeat,
    whatever the number of features; each feature then swaps one column of the placed table for its dealt one.
    """
    val = val.drop("prediction").select(*dict.fromkeys([*key, *features, spec.target]))
    base = predict(val).agg(*metrics(spec.target, "prediction")).select("mae")
    many = val.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = ("_repeat",)
    here = placed(many, keyed_order(seed, *by, *key), key, by, name="_place")
    dealt = placed(many.select(*by, *key, *features), keyed_order(seed + 1, *by, *key), key, by, name="_place").select(*by, "_place", *[F.col(f).alias(f"_new_{f}") for f in features])
    both = here.join(dealt, [*by, "_place"])
    # one row a feature: its own column is the dealt one
    each = both.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = each.select("feature", spec.target, *[F.when(F.col("feature") == f, F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    after = predict(swapped).groupBy("feature").agg(*metrics(spec.target, "prediction")).select("feature", F.col("mae").alias("after"))
    return after.crossJoin(F.broadcast(base)).select("feature", (F.col("after") - F.col("mae")).alias("importance"))


def prune_list(importance: DataFrame, least: float = 0.0005) -> DataFrame:
    """The features that gain no more than ``least``, least important first."""
    return importance.where(F.col("importance") <= least).orderBy("importance", "feature").select("feature")


def save_model(model, path: str) -> None:
    """A fitted model, to be read by ``load_model``."""
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)

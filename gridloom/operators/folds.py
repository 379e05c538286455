"""Folds: which rows a model is fitted on and which it is judged on, by month or by block of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PANEL, PanelSpec


def month_table(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """(time, k, months): the distinct months, their place from 0, and how many there are. One row a month."""
    months = df.select(spec.time).distinct()
    return months.withColumn("k", F.row_number().over(Window.orderBy(spec.time)) - 1).withColumn("months", F.count("*").over(Window.partitionBy()))


def temporal_folds(df: DataFrame, n: int, spec: PanelSpec = PANEL) -> DataFrame:
    """(time, fold, role): each fold is judged on the next ``months // (n + 1)`` months and fitted on all before them."""
    size = F.expr(f"months div {n + 1}")
    months = month_table(df, spec).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_from", F.col("months") - (F.lit(n) - F.col("fold")) * size)
    role = F.when(F.col("k") < F.col("_from"), "fit").when(F.col("k") < F.col("_from") + size, "val")
    return months.withColumn("role", role).where("role IS NOT NULL").select(spec.time, F.col("fold").cast("int").alias("fold"), "role")


def temporal_holdout(df: DataFrame, share: float, spec: PanelSpec = PANEL) -> DataFrame:
    """(time, role): the last ``share`` of the months is judged on."""
    cut = F.greatest(F.lit(1), F.floor(F.col("months") * (1 - F.lit(share))).cast("int"))
    return month_table(df, spec).select(spec.time, F.when(F.col("k") >= cut, "val").otherwise("fit").alias("role"))


def two_tier_split(df: DataFrame, inner: float = 0.15, outer: float = 0.15, spec: PanelSpec = PANEL) -> DataFrame:
    """(time, role): fit, then the months that stop training, then those that judge it."""
    a = F.floor(F.col("months") * (1 - F.lit(inner) - F.lit(outer))).cast("int")
    b = F.floor(F.col("months") * (1 - F.lit(outer))).cast("int")
    return month_table(df, spec).select(spec.time, F.when(F.col("k") < a, "fit").when(F.col("k") < b, "inner_val").otherwise("outer_val").alias("role"))


def block(spec: PanelSpec = PANEL, size: float = 10.0) -> Column:
    """The name of the square block of cells that a row lies in."""
    return F.concat_ws("_", *[F.floor(F.col(k) / size).cast("int").cast("string") for k in spec.keys])


def spatial_folds(df: DataFrame, n: int, size: float = 10.0, spec: PanelSpec = PANEL) -> DataFrame:
    """(block, fold): whole blocks, largest first, each to the fold with the fewest rows so far.

    One row a block reaches the driver: the grid's blocks, not the panel.
    """
    counts = df.groupBy(block(spec, size).alias("block")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "block").collect()
    held, out = [0] * n, []
    for r in counts:
        fold = min(range(n), key=lambda f: (held[f], f))
        held[fold] += r.n
        out.append((r.block, fold))
    return df.sparkSession.createDataFrame(out, "block string, fold int")


def spatial_holdout(df: DataFrame, share: float, size: float = 10.0, seed: int = 0, spec: PanelSpec = PANEL) -> DataFrame:
    """(block, role): whole blocks, one at least, to be judged on: the first ``share`` of them in the order of md5(seed|block). A row a block."""
    blocks = df.select(block(spec, size).alias("block")).distinct()
    place = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "block")), "block"))
    counted = blocks.select("block", place.alias("_k"), F.count("*").over(Window.partitionBy()).alias("_n"))
    return counted.select("block", F.when(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n"))), "val").otherwise("fit").alias("role"))


def with_time_folds(df: DataFrame, folds: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Each row with its folds and roles; the table has at most a row for each month and fold."""
    return df.join(folds, spec.time)


def with_space_folds(df: DataFrame, folds: DataFrame, size: float, spec: PanelSpec = PANEL) -> DataFrame:
    """Each row with the fold that judges it; ``folds`` (block, fold) has a row a block."""
    return df.withColumn("block", block(spec, size)).join(folds, "block").drop("block")


def temporal_roles(df: DataFrame, n: int, inner: float, spec: PanelSpec = PANEL) -> DataFrame:
    """``temporal_folds`` with ``stop``: the last ``inner`` of each fold's fit months (one at least), on which training can stop."""
    last = Window.partitionBy("fold", "role").orderBy(F.desc(spec.time))
    most = F.greatest(F.lit(1), F.floor(F.lit(inner) * F.count("*").over(Window.partitionBy("fold", "role"))))
    return temporal_folds(df, n, spec).withColumn("stop", (F.col("role") == "fit") & (F.row_number().over(last) <= most))


def spatial_roles(df: DataFrame, n: int, size: float, inner: float, spec: PanelSpec = PANEL) -> DataFrame:
    """(block, fold, role, stop): a block is judged on in its own fold and fitted on in the others; ``inner`` of a fold's fit blocks, drawn by md5, can stop training."""
    own = spatial_folds(df, n, size, spec).withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    roles = own.withColumn("role", F.when(F.col("_own") == F.col("fold"), "val").otherwise("fit")).drop("_own")
    drawn = Window.partitionBy("fold", "role").orderBy(F.md5(F.concat_ws("|", "fold", "block")), "block")
    most = F.greatest(F.lit(1), F.floor(F.lit(inner) * F.count("*").over(Window.partitionBy("fold", "role"))))
    return roles.withColumn("stop", (F.col("role") == "fit") & (F.row_number().over(drawn) <= most))

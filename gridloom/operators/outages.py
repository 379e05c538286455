"""Simulated outages: which months go missing, and the panel with them missing.

Months are few (hundreds), so the draw is made on a sorted list by a seeded generator; the panel
only ever sees a set of months.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index
from .panel import PANEL, PanelSpec

#: (first year, last year, rate of missing months)
Rates = Sequence[tuple[int, int, float]]


def rate_of(year: int, rates: Rates) -> float:
    return next((r for a, b, r in rates if a <= year <= b), 0.0)


def rate_column(time: Column, rates: Rates) -> Column:
    out = F.lit(0.0)
    for a, b, r in reversed(rates):
        out = F.when(F.year(time).between(a, b), F.lit(float(r))).otherwise(out)
    return out


def scaled(rates: Rates, factor: float, most: float = 0.9) -> Rates:
    return [(a, b, min(r * factor, most)) for a, b, r in rates]


def train_months(df: DataFrame, spec: PanelSpec = PANEL) -> list[dt.date]:
    return [r[0] for r in df.where(F.col(spec.train)).select(spec.time).distinct().orderBy(spec.time).collect()]


def draw_months(months: Iterable[dt.date], rates: Rates, rng: np.random.Generator) -> set[dt.date]:
    """Each month, in order, with its year's rate; a number is drawn for every month, whatever its rate."""
    return {m for m in sorted(months) if rng.random() < rate_of(m.year, rates)}


def mask_months(df: DataFrame, gap: Iterable[dt.date], spec: PanelSpec = PANEL) -> DataFrame:
    """Train rows of the given months lose their value and get the flag; test rows and targets stay."""
    hit = F.coalesce(F.col(spec.train) & F.col(spec.time).isin(sorted(gap)), F.lit(False)) if gap else F.lit(False)
    return df.withColumns({spec.value: F.when(~hit, F.col(spec.value)), spec.masked: hit | spec.is_masked()})


def streaks(months: DataFrame, time: str = "time", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, time, streak, place): runs of consecutive months, for each value of ``by``; streak is the run's first month, place counts from 1.

    Without ``by`` there is a row a month, so few; with it, cells are sorted by themselves.
    """
    island = month_index(F.col(time)) - F.row_number().over(Window.partitionBy(*by).orderBy(time))
    run = Window.partitionBy(*by, "_island")
    return months.select(*by, time).distinct().withColumn("_island", island).select(*by, time, F.min(time).over(run).alias("streak"), F.row_number().over(run.orderBy(time)).alias("place"))


def capped(months: DataFrame, longest: int, time: str = "time", by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``longest`` months of each streak."""
    return streaks(months, time, by).where(F.col("place") <= longest).select(*by, time)


def months_without_value(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """(time): the months in which no row of a panel has a value. One row a month."""
    return df.groupBy(spec.time).agg(F.count(spec.value).alias("_n")).where("_n = 0").select(spec.time)


def drawn_lengths(firsts: Iterable[dt.date], lengths: Sequence[int], rng: np.random.Generator) -> list[tuple[dt.date, int]]:
    """(streak, length): a length drawn for each streak, in order, whether or not it will grow."""
    return [(m, int(rng.choice(lengths))) for m in sorted(firsts)]


def multipliers(low: float, high: float, members: int) -> list[float]:
    """Outage-rate factors of an ensemble's members, evenly from ``low`` to ``high``."""
    return np.linspace(low, high, members).tolist()


def extended(gap: DataFrame, existing: DataFrame, length: int | DataFrame, time: str = "time") -> DataFrame:
    """Streaks shorter than ``length`` (one number, or a table of streak and length) drawn out over the next existing months.

    A streak stays as it is if too few months follow, or if one that it would take is in ``gap``.
    """
    order = existing.select(time).distinct().withColumn("_k", F.row_number().over(Window.orderBy(time)))
    ends = streaks(gap, time).groupBy("streak").agg(F.max(time).alias(time), F.count("*").alias("_n")).join(order, time)
    ends = ends.join(length, "streak") if isinstance(length, DataFrame) else ends.withColumn("length", F.lit(length))
    need = ends.where("_n < length").select("streak", F.col("_k").alias("_from"), (F.col("length") - F.col("_n")).alias("_more"))
    taken = need.join(order, (F.col("_k") > F.col("_from")) & (F.col("_k") <= F.col("_from") + F.col("_more")))
    hit = taken.join(gap.select(time).distinct().withColumn("_hit", F.lit(1)), time, "left")
    sound = hit.withColumn("_ok", (F.count("*").over(Window.partitionBy("streak")) == F.col("_more")) & (F.count("_hit").over(Window.partitionBy("streak")) == 0))
    return gap.select(time).unionByName(sound.where("_ok").select(time)).distinct()


def many_draws(df: DataFrame, gaps: dict[int, set[dt.date]], spec: PanelSpec = PANEL) -> tuple[DataFrame, PanelSpec]:
    """The panel once for each draw, masked by it, and the spec whose keys tell the draws apart."""
    spark = df.sparkSession
    months = spark.createDataFrame([(d, m, True) for d, gap in sorted(gaps.items()) for m in sorted(gap)], f"draw int, {spec.time} date, _hit boolean")
    rows = df.withColumn("draw", F.explode(F.array(*[F.lit(d) for d in sorted(gaps)])))
    rows = rows.join(F.broadcast(months), ["draw", spec.time], "left")  # a row a draw and month
    hit = F.coalesce(F.col("_hit") & F.col(spec.train), F.lit(False))
    rows = rows.withColumns({spec.value: F.when(~hit, F.col(spec.value)), spec.masked: hit | spec.is_masked()}).drop("_hit")
    from dataclasses import replace

    return rows, replace(spec, keys=("draw", *spec.keys))

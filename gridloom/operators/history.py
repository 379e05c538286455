"""Features of a cell's past: lags, differences, rolling means, trend, climatology, last observation.

A lag is a number of rows back in the cell, whatever months are missing between; the horizon counts
calendar months. Nothing depends on a later row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index
from .panel import PANEL, PanelSpec

FIRST = Window.unboundedPreceding


def lags(column: str, steps: tuple[int, ...], spec: PanelSpec = PANEL) -> dict[str, Column]:
    return {f"{column}_lag{k}": F.lag(column, k).over(spec.steps()) for k in steps}


def differences(column: str, steps: tuple[int, ...]) -> dict[str, Column]:
    """The value less its lag, for lags that are among the columns."""
    return {f"{column}_diff{k}": F.col(column) - F.col(f"{column}_lag{k}") for k in steps}


def rolling_means(column: str, widths: tuple[int, ...], spec: PanelSpec = PANEL) -> dict[str, Column]:
    """Means over the last rows, this one included; NULLs are skipped, and a window of NULLs only gives NULL."""
    return {f"{column}_rollmean{n}": F.avg(column).over(spec.steps().rowsBetween(1 - n, 0)) for n in widths}


def earlier_mean(column: str, window) -> Column:
    return F.avg(column).over(window.rowsBetween(FIRST, -1))


def earlier_count(column: str, window) -> Column:
    """How many earlier rows have a value; NULL on a window's first row."""
    return F.when(F.row_number().over(window) > 1, F.count(column).over(window.rowsBetween(FIRST, -1)))


def trend(columns: tuple[str, ...], spec: PanelSpec = PANEL) -> dict[str, Column]:
    """Mean and count of each column over strictly earlier rows of the cell."""
    out = {}
    for c in columns:
        out[f"{c}_trend_mean"] = earlier_mean(c, spec.steps())
        out[f"{c}_trend_count"] = earlier_count(c, spec.steps())
    return out


def climatology(spec: PanelSpec = PANEL) -> dict[str, Column]:
    """Mean and count of the value in the same calendar month of strictly earlier years, and the value less that mean."""
    mean = earlier_mean(spec.value, spec.seasons())
    return {"climatology_mean": mean, "climatology_count": earlier_count(spec.value, spec.seasons()), "anomaly": F.col(spec.value) - mean}


def last_observed(spec: PanelSpec = PANEL) -> dict[str, Column]:
    """The last unmasked value and the months from its step to the month after this row's; each is carried on by itself."""
    upto = spec.steps().rowsBetween(FIRST, 0)
    seen = ~spec.is_masked()
    time = F.last(F.when(seen, F.col(spec.time)), ignorenulls=True).over(upto)
    return {
        "last_observed": F.last(F.when(seen, F.col(spec.value)), ignorenulls=True).over(upto),
        "months_since_observed": (month_index(F.add_months(spec.time, 1)) - month_index(time)).cast("int"),
    }


def last_valued(spec: PanelSpec = PANEL) -> dict[str, Column]:
    """As ``last_observed``, by the value alone: a step counts as seen where its value is not NULL, whatever its flag."""
    upto = spec.steps().rowsBetween(FIRST, 0)
    seen = F.col(spec.value).isNotNull()
    time = F.last(F.when(seen, F.col(spec.time)), ignorenulls=True).over(upto)
    return {"last_observed": F.last(spec.value, ignorenulls=True).over(upto), "months_since_observed": (month_index(F.add_months(spec.time, 1)) - month_index(time)).cast("int")}


def add_history(df: DataFrame, spec: PanelSpec = PANEL, value_lags=(1, 3, 6, 12), covariate_lags=(1, 3), widths=(3, 6, 12)) -> DataFrame:
    """All of the above: one select for what needs rows only, one for differences, one for what needs those."""
    first = lags(spec.value, value_lags, spec) | rolling_means(spec.value, widths, spec) | climatology(spec) | last_observed(spec)
    for c in spec.covariates:
        if c in df.columns:
            first |= lags(c, covariate_lags, spec)
    steps = tuple(k for k in (1, 12) if k in value_lags)
    df = df.withColumns(first).withColumns(differences(spec.value, steps))
    return df.withColumns(trend(tuple(f"{spec.value}_diff{k}" for k in steps), spec))


def masked_runs(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """For each cell: runs of masked steps, and whether it never comes back once masked."""
    before = F.coalesce(F.lag(spec.is_masked()).over(spec.steps()), F.lit(False))
    rows = df.withColumn("_m", spec.is_masked()).withColumn("_rise", F.col("_m") & ~before)
    first, last = F.min(F.when(F.col("_m"), F.col(spec.time))), F.max(F.when(~F.col("_m"), F.col(spec.time)))
    return rows.groupBy(*spec.keys).agg(F.count_if("_rise").alias("runs"), F.coalesce(first > last, F.lit(False)).alias("cumulative"))

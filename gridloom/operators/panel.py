"""The panel: one row for each cell and time step, a value that can be missing, covariates and flags.

Every operator takes a ``PanelSpec``, so key, time and value columns can have any names. Missing is
always NULL; ``no_nan`` turns NaN into NULL once, at the edge. No operator relies on row order: each
states its own window. All windows of a cell share one partitioning, (keys) in the same order, so a
chain of them needs one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    keys: tuple[str, ...] = ("lat", "lon")
    time: str = "time"
    value: str = "value"
    covariates: tuple[str, ...] = ("cov_quantity", "cov_discount", "cov_count")
    masked: str = "masked"
    train: str = "is_train"
    target: str = "target"

    def steps(self) -> WindowSpec:
        """The rows of a cell in time order."""
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def seasons(self) -> WindowSpec:
        """The rows of a cell in one calendar month, in time order; satisfied by a partitioning on the keys."""
        return Window.partitionBy(*self.keys, F.month(self.time)).orderBy(self.time)

    def is_masked(self) -> Column:
        return F.coalesce(F.col(self.masked), F.lit(False))


PANEL = PanelSpec()


def no_nan(df: DataFrame) -> DataFrame:
    """Double and float columns with NaN turned into NULL."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def union_panels(train: DataFrame, test: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Both tables by column name: the train flag set, absent columns NULL, an absent mask flag false."""
    both = train.withColumn(spec.train, F.lit(True)).unionByName(test.withColumn(spec.train, F.lit(False)), allowMissingColumns=True)
    masked = F.coalesce(F.col(spec.masked), F.lit(False)) if spec.masked in both.columns else F.lit(False)
    return both.withColumn(spec.masked, masked)


def split_panel(df: DataFrame, spec: PanelSpec = PANEL) -> tuple[DataFrame, DataFrame]:
    """(train rows without the flag, test rows without flag and target); windows belong before this."""
    return df.where(F.col(spec.train)).drop(spec.train), df.where(~F.col(spec.train)).drop(spec.train, spec.target)


def broken_rules(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """(rule, rows) for what a panel must satisfy: unique cells and times, mask flag exactly where the value is missing, targets on train rows."""
    repeated = df.groupBy(*spec.keys, spec.time).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit("repeated_step").alias("rule"), "rows")
    flag = spec.is_masked() != F.col(spec.value).isNull()
    counts = df.agg(F.count_if(flag).alias("flag_and_value"), F.count_if(~F.col(spec.train) & F.col(spec.target).isNotNull()).alias("target_on_test"))
    return repeated.unionByName(counts.unpivot([], ["flag_and_value", "target_on_test"], "rule", "rows"))


def shared_columns(*tables: DataFrame) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]


def feature_columns(df: DataFrame, exclude: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in exclude]

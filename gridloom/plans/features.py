"""The feature pipeline: one lazy plan from a panel to its features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions.calendar import cyclic_month
from ..operators.history import add_history
from ..operators.neighbours import add_neighbours
from ..operators.outages import mask_months
from ..operators.panel import PANEL, PanelSpec


def build_features(panel: DataFrame, spec: PanelSpec = PANEL, gap: Iterable | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Every feature of a row depends on rows up to its own step, and on the calendar month after it. ``cells``: the panel's cells, if cheaply known."""
    if gap:
        panel = mask_months(panel, gap, spec)
    rows = add_neighbours(add_history(panel, spec), spec, cells=cells)
    return rows.withColumns(cyclic_month(spec.time))


def not_features(spec: PanelSpec = PANEL) -> tuple[str, ...]:
    """Keys, time, flags and target are never features."""
    return (*spec.keys, spec.time, spec.masked, spec.train, spec.target, "ID")


#: Sets of features by name: prefixes of the columns that each leaves out.
VARIANTS = {"all": (), "no_neighbours": ("north_", "south_", "east_", "west_"), "no_covariates": ("cov_",), "no_trend": ("value_diff1_", "value_diff12_")}


def variant(names: list[str], which: str) -> list[str]:
    """The features of a named set, in order."""
    return [n for n in names if not n.startswith(VARIANTS[which])] if VARIANTS[which] else list(names)

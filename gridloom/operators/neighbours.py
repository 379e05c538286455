"""Nearest existing cells in four directions, and their last observations.

Neighbours are found once, on distinct cells: a neighbour without a row in some month gives NULL
there, not the next cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PANEL, PanelSpec

SIDES = ("north", "south", "east", "west")
CARRIED = ("last_observed", "months_since_observed")
OPPOSITE = {"north": "south", "south": "north", "east": "west", "west": "east"}


def neighbour_lookup(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """For each cell, the coordinates of the next existing cell on each side of the grid; NULL at an edge. The last two keys are the coordinates."""
    y, x = spec.keys[-2:]
    up, across = Window.partitionBy(x).orderBy(y), Window.partitionBy(y).orderBy(x)
    return df.select(y, x).distinct().withColumns({
        "north": F.lead(y).over(up), "south": F.lag(y).over(up), "east": F.lead(x).over(across), "west": F.lag(x).over(across),
    })


def cell_name(*keys: str) -> Column:
    """A cell's keys as text. Spark partitions by doubles only after setting -0.0 and NaN straight, so an exchange by such keys serves no window."""
    return F.concat_ws("|", *[F.coalesce((F.col(k) + F.lit(0.0)).cast("string"), F.lit("")) for k in keys])


def add_neighbours(df: DataFrame, spec: PanelSpec = PANEL, carried: tuple[str, ...] = CARRIED, cells: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Adds each side's ``carried`` columns. Scatter form: every row stays, whole, and goes with what is carried to the cells that it neighbours.

    One exchange brings a cell's own row and its neighbours' together, so ``df`` is computed once; the lookup has a row a
    cell, which Spark broadcasts if its size at run time is small. It comes from ``cells`` (the coordinates of every cell
    that ``df`` has) if they can be had more cheaply than from ``df``, and then nothing is computed twice. With ``parts`` the
    exchange is by cell (column ``_cell``, which comes first), in so many parts, and windows over cells need no other.
    """
    y, x = spec.keys[-2:]
    more = spec.keys[:-2]
    lookup = neighbour_lookup(df if cells is None else cells, spec)
    own = df.columns
    to = [F.struct(F.lit("").alias("side"), F.col(y).alias("y"), F.col(x).alias("x"))]
    # a row is the southern neighbour of the cell to its north
    to += [F.when(F.col(s).isNotNull(), F.struct(F.lit(o).alias("side"), (F.col(s) if s in ("north", "south") else F.col(y)).alias("y"), (F.col(s) if s in ("east", "west") else F.col(x)).alias("x"))) for s, o in OPPOSITE.items()]
    sent = df.join(lookup, [y, x], "left").withColumn("_to", F.explode(F.array_compact(F.array(*to))))
    here = F.col("_to.side") == ""
    rows = sent.select(F.when(here, F.struct(*own)).alias("_row"), F.col("_to.side").alias("_side"), *more, F.col("_to.y").alias("_y"), F.col("_to.x").alias("_x"), F.col(spec.time).alias("_time"), *[F.col(c).alias(f"_{c}") for c in carried])
    met = Window.partitionBy(*more, "_y", "_x", "_time")
    if parts:
        rows, met = rows.withColumn("_cell", cell_name("_y", "_x")).repartition(parts, *more, "_cell"), Window.partitionBy(*more, "_cell", "_time")
    gathered = rows.withColumns({f"{s}_{c}": F.max(F.when(F.col("_side") == s, F.col(f"_{c}"))).over(met) for s in SIDES for c in carried})
    return gathered.where(F.col("_row").isNotNull()).select(*(["_cell"] if parts else []), "_row.*", *[f"{s}_{c}" for s in SIDES for c in carried])


def add_neighbours_by_pull(df: DataFrame, spec: PanelSpec = PANEL, carried: tuple[str, ...] = CARRIED) -> DataFrame:
    """The same by four left joins; kept to hold the scatter form against."""
    y, x = spec.keys
    out, lookup = df, neighbour_lookup(df, spec)
    seen = df.select(y, x, spec.time, *carried)
    for s in SIDES:
        own = lookup.select(y, x, (F.col(s) if s in ("north", "south") else F.col(y)).alias("_y"), (F.col(s) if s in ("east", "west") else F.col(x)).alias("_x"))
        theirs = seen.select(F.col(y).alias("_y"), F.col(x).alias("_x"), spec.time, *[F.col(c).alias(f"{s}_{c}") for c in carried])
        out = out.join(own, [y, x], "left").join(theirs, ["_y", "_x", spec.time], "left").drop("_y", "_x")
    return out


def nearest_point(cells: DataFrame, lat: float, lon: float, spec: PanelSpec = PANEL) -> DataFrame:
    """One row: the grid's latitude and longitude nearest to a point, each for itself (the smaller of a tie)."""
    y, x = spec.keys
    return cells.agg(F.min_by(y, F.struct(F.abs(F.col(y) - lat), y)).alias(y), F.min_by(x, F.struct(F.abs(F.col(x) - lon), x)).alias(x))


def snapped(points: DataFrame, axis: DataFrame, point: str, value: str, out: str, size: float = 1.0, salts: int = 8) -> DataFrame:
    """``points`` with ``out``: the value of ``axis`` nearest to the column ``point`` (the smaller of a tie), by a sorted merge; NULL for NULL, or without any.

    Both tables are dealt to stretches of the number line ``size`` wide, in which windows carry the last value before and
    the first one after each point; what lies in other stretches comes from a table of a row a stretch. Points of a
    stretch are dealt to ``salts`` tasks, each with the stretch's (distinct) values. No pair of rows is made.
    """
    cut = lambda c: F.floor(F.col(c) / size)
    values = axis.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).distinct()
    names = points.columns
    rows = points.withColumn("_at", F.nanvl(F.col(point).cast("double"), F.lit(None).cast("double"))).withColumn("_b", cut("_at"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    ends = values.groupBy(cut("_v").alias("_b")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stretches = rows.select("_b").where("_b IS NOT NULL").distinct().join(ends, "_b", "full")  # a row a stretch
    order = Window.orderBy("_b")
    stretches = stretches.select("_b", F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    dealt = values.select(F.col("_v").alias("_at"), "_v", cut("_v").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    line = rows.withColumn("_point", F.lit(True)).unionByName(dealt.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    here = Window.partitionBy("_b", "_salt").orderBy("_at")
    line = line.withColumns({"_under": F.max("_v").over(here.rangeBetween(Window.unboundedPreceding, 0)), "_over": F.min("_v").over(here.rangeBetween(0, Window.unboundedFollowing))})
    found = line.where("_point").join(stretches, "_b", "left").withColumns({"_under": F.coalesce("_under", "_below"), "_over": F.coalesce("_over", "_above")})
    nearer = F.when(F.col("_under").isNull() | (F.col("_over") - F.col("_at") < F.col("_at") - F.col("_under")), F.col("_over")).otherwise(F.col("_under"))
    return found.select(*names, F.when(F.col("_at").isNotNull(), nearer).alias(out))


def nearest_cells(points: DataFrame, cells: DataFrame, spec: PanelSpec = PANEL, size: float = 1.0) -> DataFrame:
    """Each point with the grid's nearest latitude and longitude, ``near_lat`` and so on, each for itself."""
    out = points
    for k in spec.keys[-2:]:
        out = snapped(out, cells, k, k, f"near_{k}", size)
    return out

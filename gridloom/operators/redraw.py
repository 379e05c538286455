"""Features of many outage draws by difference from those of the unmasked panel.

A masked month touches nothing before it. After it, lags and rolling means change for as many rows as they look back,
the last observation until the next value, and the expanding means (trend, climatology) for good, but only by what was
taken from their sums. So the unmasked features are computed and stored once, with each row's rank in its cell and the
sums behind the expanding means. A draw finds the first rank of each cell that it masks, takes the rows from there on
(and as many before as lags look back), recomputes those, and leaves all others as they are stored. All of it runs where a
cell's rows are, so a table that is stored in buckets of cells (``store_by_cell``) is not exchanged again, however many draws come.

Sums of whole numbers below 2**53 are exact, so the features equal those of ``outages.many_draws`` row for row; of other
doubles they differ in rounding alone. A step counts as seen where it has a value, as in ``history.last_valued``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import cyclic_month, month_index
from . import history as hi
from . import neighbours as ne
from .panel import PANEL, PanelSpec

LAGS, WIDTHS, DIFFS = (1, 3, 6, 12), (3, 6, 12), (1, 12)
#: Rows before the first masked one that a recomputed row can look back to.
BACK = max(*LAGS, *WIDTHS)
#: Rows of all draws in a task, about.
TASK_ROWS = 1 << 18
#: Stored rows in a bucket of cells, about.
BUCKET_ROWS = 1 << 16


def feature_names(spec: PanelSpec = PANEL) -> list[str]:
    """What a draw changes, in order."""
    v = spec.value
    return [
        *(f"{v}_lag{k}" for k in LAGS), *(f"{v}_rollmean{n}" for n in WIDTHS), "climatology_mean", "climatology_count", "anomaly", "last_observed", "months_since_observed",
        *(f"{v}_diff{k}" for k in DIFFS), *(f"{v}_diff{k}_trend_{m}" for k in DIFFS for m in ("mean", "count")),
    ]


def unmasked_features(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """The features without a draw, and what draws need: ``_rank``, ``_seen_time``, sums of differences and of the season's values. To be written."""
    v = spec.value
    seasons = spec.seasons().rowsBetween(hi.FIRST, -1)
    seen = F.last(F.when(F.col(v).isNotNull(), F.col(spec.time)), ignorenulls=True).over(spec.steps().rowsBetween(hi.FIRST, 0))
    rows = df.withColumns(
        hi.lags(v, LAGS, spec) | hi.rolling_means(v, WIDTHS, spec) | hi.climatology(spec) | hi.last_valued(spec)
        | {"_rank": F.row_number().over(spec.steps()), "_seen_time": seen, "_season_sum": F.coalesce(F.sum(F.col(v).cast("double")).over(seasons), F.lit(0.0))}
    )
    rows = rows.withColumns(hi.differences(v, DIFFS))
    before = spec.steps().rowsBetween(hi.FIRST, -1)
    sums = {f"_diff{k}_sum": F.coalesce(F.sum(F.col(f"{v}_diff{k}").cast("double")).over(before), F.lit(0.0)) for k in DIFFS}
    return rows.withColumns(hi.trend(tuple(f"{v}_diff{k}" for k in DIFFS), spec) | sums)


def store_by_cell(df: DataFrame, rows: int, path: str, spec: PanelSpec = PANEL) -> DataFrame:
    """``unmasked_features`` of ``df`` (of some ``rows``), and its covariates' lags, written to ``path`` in buckets of cells of about ``BUCKET_ROWS``, a file each, and read back.

    Cells go by a name, since Spark doesn't take a partitioning by doubles for that of a window.
    """
    spark, cells = df.sparkSession, replace(spec, keys=("_cell",))
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    lagged: dict = {}
    for c in spec.covariates:
        if c in df.columns:
            lagged |= hi.lags(c, (1, 3), cells)
    made = unmasked_features(df.withColumn("_cell", ne.cell_name(*spec.keys)).repartition(parts, "_cell").withColumns(lagged), cells).withColumns(cyclic_month(spec.time))
    name = f"by_cell_{uuid.uuid4().hex}"
    made.write.bucketBy(parts, "_cell").option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def redrawn(stored: DataFrame, gaps: dict[int, set[dt.date]], spec: PanelSpec = PANEL) -> tuple[DataFrame, DataFrame]:
    """(rows that the draws change, rows that they don't), each with ``draw``, keys, time, other columns and features; ``stored``: written ``unmasked_features``.

    Their union is the panel once a draw.
    """
    spark, v, t = stored.sparkSession, spec.value, spec.time
    months = spark.createDataFrame([(d, m) for d, gap in sorted(gaps.items()) for m in sorted(gap)], f"draw int, {t} date")
    keys, draws = ["_cell"] if "_cell" in stored.columns else list(spec.keys), sorted(gaps)
    open_ = F.col(spec.train) & (F.col(v).isNotNull() | ~spec.is_masked())
    # each draw's first rank in the cell, found before rows become one a draw
    firsts = [F.min(F.when(open_ & F.col(t).isin(sorted(gaps[d])), F.col("_rank"))).over(Window.partitionBy(*keys)) if gaps[d] else F.lit(None).cast("int") for d in draws]
    one = F.array(*[F.struct(F.lit(d).alias("draw"), x.alias("_first")) for d, x in zip(draws, firsts, strict=True)])
    placed = stored.withColumn("_one", one).select("*", F.inline("_one")).drop("_one")
    untouched = placed.where(F.col("_first").isNull() | (F.col("_rank") < F.col("_first"))).drop("_first")
    # what is read: from BACK rows before the first masked one
    slice_ = placed.where(F.col("_rank") >= F.col("_first") - BACK).join(F.broadcast(months.withColumn("_hit", F.lit(True))), ["draw", t], "left")
    own = replace(spec, keys=("draw", *keys))
    masks = F.coalesce(F.col("_hit") & F.col(spec.train), F.lit(False))
    old = {c: f"_old_{c}" for c in (v, "last_observed", "climatology_count", *(f"{v}_diff{k}" for k in DIFFS), *(f"{v}_diff{k}_trend_count" for k in DIFFS))}
    rows = slice_.withColumnsRenamed(old).withColumns({v: F.when(~masks, F.col(f"_old_{v}")), spec.masked: masks | spec.is_masked()})
    upto, before = own.steps().rowsBetween(hi.FIRST, 0), own.steps().rowsBetween(hi.FIRST, -1)
    season = own.seasons().rowsBetween(hi.FIRST, -1)
    taken = F.when(F.col(v).isNull(), F.col(f"_old_{v}").cast("double"))
    here = F.last(F.when(F.col(v).isNotNull(), F.col(t)), ignorenulls=True).over(upto)
    rows = rows.withColumns(
        hi.lags(v, LAGS, own) | hi.rolling_means(v, WIDTHS, own)
        | {
            "_at": F.coalesce(here, F.first(F.when(F.col("_rank") < F.col("_first"), F.col("_seen_time"))).over(upto)), "last_observed": F.coalesce(F.last(v, ignorenulls=True).over(upto), F.first(F.when(F.col("_rank") < F.col("_first"), F.col("_old_last_observed"))).over(upto)),
            "_less": F.coalesce(F.sum(taken).over(season), F.lit(0.0)), "_fewer": F.count(taken).over(season),
        }
    ).withColumns(hi.differences(v, DIFFS))
    left = F.col("_old_climatology_count") - F.col("_fewer")
    mean = F.when(left > 0, (F.col("_season_sum") - F.col("_less")) / left)
    made = {"climatology_mean": mean, "climatology_count": left, "months_since_observed": (month_index(F.add_months(t, 1)) - month_index(F.col("_at"))).cast("int")}
    for k in DIFFS:
        gone = F.when((F.col("_rank") >= F.col("_first")) & F.col(f"{v}_diff{k}").isNull(), F.col(f"_old_{v}_diff{k}").cast("double"))
        n = F.col(f"_old_{v}_diff{k}_trend_count") - F.count(gone).over(before)
        made[f"{v}_diff{k}_trend_count"] = n
        made[f"{v}_diff{k}_trend_mean"] = F.when(n > 0, (F.col(f"_diff{k}_sum") - F.coalesce(F.sum(gone).over(before), F.lit(0.0))) / n)
    rows = rows.withColumns(made).withColumn("anomaly", F.col(v) - F.col("climatology_mean"))
    kept = ["draw", *[c for c in stored.columns if not c.startswith("_")]]
    changed = rows.where(F.col("_rank") >= F.col("_first"))
    return changed.select(*kept), untouched.select(*kept)


def many_redrawn(stored: DataFrame, gaps: dict[int, set[dt.date]], spec: PanelSpec = PANEL) -> DataFrame:
    """The panel with its features once a draw: recomputed rows beside stored ones."""
    changed, untouched = redrawn(stored, gaps, spec)
    return changed.unionByName(untouched)


def drawn_features(stored: DataFrame, gaps: dict[int, set[dt.date]], spec: PanelSpec = PANEL) -> DataFrame:
    """The features of ``build_features`` on ``outages.many_draws``, neighbours' included, with no exchange of a draw's rows; ``stored``: a written panel.

    A draw masks months of all cells alike, so last observations of all draws are found on the panel itself, in arrays with a
    place a draw, and only these go to the neighbours. A cell's rows become a draw's where its windows run. Tasks are as
    many as the rows of all draws need, so what one holds doesn't grow with the table.
    """
    t, v, keys, draws = spec.time, spec.value, list(spec.keys), sorted(gaps)
    parts = max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() * len(draws) // TASK_ROWS))
    cells = replace(spec, keys=("_cell",))
    upto = cells.steps().rowsBetween(hi.FIRST, 0)

    def seen(draw: int):
        hit = F.col(spec.train) & F.col(t).isin(sorted(gaps[draw])) if gaps[draw] else F.lit(False)
        here = ~(F.coalesce(hit, F.lit(False)) | spec.is_masked())
        time = F.last(F.when(here, F.col(t)), ignorenulls=True).over(upto)
        months = (month_index(F.add_months(t, 1)) - month_index(time)).cast("int")
        return F.struct(F.last(F.when(here, F.col(v)), ignorenulls=True).over(upto).alias("last_observed"), months.alias("months_since_observed"))

    lagged: dict = {}
    for c in spec.covariates:
        if c in stored.columns:
            lagged |= hi.lags(c, (1, 3), cells)
    rows = stored.withColumn("_cell", ne.cell_name(*keys)).repartition(parts, "_cell").withColumns(lagged | {"_seen": F.array(*[seen(d) for d in draws])})
    rows = ne.add_neighbours(rows.drop("_cell"), spec, ("_seen",), stored.select(*keys).distinct(), parts)
    rest = [c for c in rows.columns if not c.endswith("_seen")]
    exploded = rows.select("*", F.posexplode(F.array(*[F.lit(d) for d in draws])).alias("_at", "draw"))
    sides = {"": "_seen"} | {f"{s}_": f"{s}__seen" for s in ne.SIDES}
    drawn = exploded.select("draw", *rest, *[F.get(F.col(c), F.col("_at"))[n].alias(f"{s}{n}") for s, c in sides.items() for n in ne.CARRIED])
    months = stored.sparkSession.createDataFrame([(d, m, True) for d in draws for m in sorted(gaps[d])], f"draw int, {t} date, _hit boolean")
    drawn = drawn.join(F.broadcast(months), ["draw", t], "left")  # a row a draw and month
    hit = F.coalesce(F.col("_hit") & F.col(spec.train), F.lit(False))
    drawn = drawn.withColumns({v: F.when(~hit, F.col(v)), spec.masked: hit | spec.is_masked()}).drop("_hit")
    own = replace(spec, keys=("draw", "_cell"))
    drawn = drawn.withColumns(hi.lags(v, LAGS, own) | hi.rolling_means(v, WIDTHS, own) | hi.climatology(own)).withColumns(hi.differences(v, DIFFS))
    return drawn.withColumns(hi.trend(tuple(f"{v}_diff{k}" for k in DIFFS), own)).withColumns(cyclic_month(t)).drop("_cell")

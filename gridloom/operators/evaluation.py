"""Error metrics, their summaries and breakdowns, ensembles, and statistics of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import climate_zone, latitude_band, season
from .panel import PANEL, PanelSpec


def persistence(spec: PanelSpec = PANEL) -> Column:
    """The forecast that needs no training: the last observed value, else the cell's climatology."""
    return F.coalesce(F.col("last_observed").cast("double"), F.col("climatology_mean"))


def metrics(target: str, prediction: str) -> list[Column]:
    """n, mean absolute error, root mean square error, and 1 - residual / total sum of squares. Rows without either value don't count."""
    both = F.col(target).isNotNull() & F.col(prediction).isNotNull()
    y, e = F.when(both, F.col(target).cast("double")), F.when(both, F.col(target) - F.col(prediction))
    total = F.var_pop(y) * F.count(e)
    return [
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(total > 0, 1 - F.sum(e * e) / total).when(F.count(e) > 0, (F.sum(e * e) == 0).cast("double")).alias("r2"),  # a constant target: 1 if met, else 0
    ]


def fold_summary(per_fold: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return per_fold.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("mae", "rmse", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def error_dimensions(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds climate_zone, lat_band, season, horizon (8 stands for 8 or more)."""
    h = F.col("months_since_observed")
    return df.withColumns({
        "climate_zone": climate_zone(spec.keys[0]), "lat_band": latitude_band(spec.keys[0]), "season": season(spec.time, spec.keys[0]),
        "horizon": F.when(h.isNotNull(), F.least(h, F.lit(8))),
    })


def percentiles(df: DataFrame, shares: dict[str, list[float]], parts: int = 200) -> DataFrame:
    """One row with an array for each column: its exact percentiles (between two values in proportion), NULL without values.

    No task holds a whole column: equal values are counted first, approximate cuts deal the distinct ones to ``parts``
    ranges, and ranks are running sums within a range after the totals of the ranges before (a row each).
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in shares]).unpivot([], list(shares), "_column", "_x")
    counts = long.where(F.col("_x").isNotNull()).groupBy("_column", "_x").agg(F.count("*").alias("_n"))
    cuts = counts.groupBy("_column").agg(F.percentile_approx("_x", [k / parts for k in range(1, parts)], parts * 10).alias("_cuts"))
    # a row a column on the right
    ranged = counts.join(F.broadcast(cuts), "_column").withColumn("_range", F.size(F.filter("_cuts", lambda cut: cut < F.col("_x")))).drop("_cuts")
    totals = ranged.groupBy("_column", "_range").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most ``parts`` rows a column
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "_all": F.sum("_m").over(Window.partitionBy("_column"))})
    upto = Window.partitionBy("_column", "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(F.broadcast(totals), ["_column", "_range"]).withColumn("_last", F.col("_before") + F.sum("_n").over(upto) - 1)
    out = []
    for c, ps in shares.items():
        found = []
        for p in ps:
            place = F.lit(float(p)) * (F.col("_all") - 1)
            at = lambda k: F.max(F.when((F.col("_column") == c) & (F.col("_last") - F.col("_n") < k) & (k <= F.col("_last")), F.col("_x")))  # noqa: B023, E731
            low, high = at(F.floor(place)), at(F.ceil(place))
            part = F.max(F.when(F.col("_column") == c, place - F.floor(place)))
            found.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high))
        out.append(F.when(F.count_if(F.col("_column") == c) > 0, F.array(*found)).alias(c))
    return ranked.agg(*out)


LEVELS = ("very low", "low", "mid", "high", "very high")


def value_level(df: DataFrame, column: str) -> DataFrame:
    """Adds ``level``: the quintile (exact, right-closed, lowest included) of a column. One row of four cuts is broadcast."""
    cuts = percentiles(df, {column: [0.2, 0.4, 0.6, 0.8]}).toDF("_q")
    out = F.when(F.col(column).isNull(), None)
    for i, name in enumerate(LEVELS[:-1]):
        out = out.when(F.col(column) <= F.col("_q")[i], name)
    return df.crossJoin(F.broadcast(cuts)).withColumn("level", out.otherwise(LEVELS[-1])).drop("_q")


def error_by(df: DataFrame, dimension: str, error: str = "abs_error") -> DataFrame:
    """Mean error and rows of each value of a dimension; rows without one don't count."""
    return df.where(F.col(dimension).isNotNull() & F.col(error).isNotNull()).groupBy(dimension).agg(F.avg(error).alias("mae"), F.count("*").alias("n"))


DIMENSIONS = ("climate_zone", "lat_band", "season", "horizon", "level")


def error_breakdowns(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, error: str = "abs_error") -> DataFrame:
    """(dimension, value, mae, n): mean error and rows by each value of each dimension, from one scan and one aggregate. Values are text."""
    rows = df.where(F.col(error).isNotNull()).select(*[F.col(d).cast("string").alias(d) for d in dimensions], F.col(error).alias("_e"))
    sums = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(F.avg("_e").alias("mae"), F.count("*").alias("n"), F.grouping_id().alias("_set"))
    last = len(dimensions) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in enumerate(dimensions):  # a set's bits are those of the columns that it leaves out
        mine = F.col("_set") == (2 ** len(dimensions) - 1 - 2 ** (last - k))
        which, value = F.when(mine, d).otherwise(which), F.when(mine, F.col(d)).otherwise(value)
    return sums.select(which.alias("dimension"), value.alias("value"), "mae", "n").where("value IS NOT NULL")


def ensemble_mean(members: DataFrame, *key: str) -> DataFrame:
    return members.groupBy(*key).agg(F.avg("prediction").alias("prediction"), F.count("*").alias("members"))


def ensemble_curve(members: DataFrame, *key: str) -> DataFrame:
    """For each row and N: the mean of its first N members."""
    upto = Window.partitionBy(*key).orderBy("member").rowsBetween(Window.unboundedPreceding, 0)
    return members.withColumn("prediction", F.avg("prediction").over(upto)).withColumn("n_models", F.count("*").over(upto).cast("int"))


def best_member_count(curve: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(best, enough): the N of the least error, and the smallest N within a tolerance of that error."""
    best = curve.agg(F.min_by("n_models", F.struct("mae", "n_models")).alias("best"), F.min("mae").alias("_least"))
    near = curve.crossJoin(F.broadcast(best)).where(F.col("mae") <= (1 + tolerance) * F.col("_least"))
    return near.groupBy("best").agg(F.min("n_models").alias("enough"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, deviation, least, exact quartiles, greatest."""
    x = F.col(column).cast("double")
    whole = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    cuts = percentiles(df, {column: [0.25, 0.5, 0.75]}).toDF("_q")
    return whole.crossJoin(F.broadcast(cuts)).select("count", "mean", "std", "min", *[F.col("_q")[k].alias(q) for k, q in enumerate(("q25", "q50", "q75"))], "max")


def null_shares(df: DataFrame, *columns: str) -> DataFrame:
    """(column, share): the percentage of NULLs."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "column", "share")


def median_impute(fit: DataFrame, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with NULLs replaced by the exact medians of ``fit``: one broadcast row."""
    return imputed(medians(fit, *columns), df, *columns)


def medians(df: DataFrame, *columns: str) -> DataFrame:
    """One row of exact medians."""
    return percentiles(df, {c: [0.5] for c in columns}).select(*[F.col(c)[0].alias(c) for c in columns])


def imputed(medians: DataFrame, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with NULLs replaced by the one row ``medians``."""
    medians = medians.select(*[F.col(c).alias(f"_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in columns})
    return filled.drop(*[f"_{c}" for c in columns])


def standardise(fit: DataFrame, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` less the mean of ``fit``, over its population deviation (1 where that is 0)."""
    stats = fit.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal bins from the least to the greatest value, the last one closed."""
    ends = df.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_b"))
    at = F.least(F.floor((F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def template_join(template: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The template's rows with their predictions; a repeated key on either side, or a missing prediction, stops the job."""
    once = lambda df, side: df.withColumn(f"_{side}", F.count("*").over(Window.partitionBy(key)))
    both = once(template, "template").join(once(predictions.withColumn("_found", F.lit(True)), "predictions"), key, "left")
    wrong = F.when((F.col("_template") > 1) | (F.col("_predictions") > 1), F.raise_error(F.concat(F.lit("a key is repeated: "), key)))
    wrong = wrong.when(F.col("_found").isNull() | F.col("prediction").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), key)))
    return both.withColumn("prediction", wrong.otherwise(F.col("prediction"))).drop("_template", "_predictions", "_found")


def metric_gains(metrics_by: DataFrame, model: str, base: str, *by: str) -> DataFrame:
    """Each model's metrics less those of the model called ``base``, in the same group ``by``."""
    names = [c for c in ("mae", "rmse", "r2") if c in metrics_by.columns]
    ground = metrics_by.where(F.col(model) == base).select(*by, *[F.col(c).alias(f"_{c}") for c in names])
    rows = metrics_by.where(F.col(model) != base)
    rows = rows.join(ground, list(by)) if by else rows.crossJoin(F.broadcast(ground))  # one row
    return rows.select(model, *by, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_gain") for c in names])


def smoothed_stop(scores: list[float], patience: int, width: int = 4) -> int:
    """The step of the least mean of the last ``width`` scores, reading on until ``patience`` steps brought nothing better."""
    best, at = float("inf"), -1
    for k in range(len(scores)):
        mean = sum(scores[max(0, k - width + 1) : k + 1]) / min(width, k + 1)
        if mean < best:
            best, at = mean, k
        elif k - at >= patience:
            break
    return at

"""Experiments with fitted members: every member, fold, setting and feature set of one is a model of the same fit."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import evaluation as ev
from ..operators import folds as fo
from ..operators import forecast as fc
from ..operators import outages as ou
from ..operators import redraw as rd
from ..operators.panel import feature_columns
from ..sources import tables as src
from .catalog import GAP, ID, MEMBERS, RATES, _r, panel, query, shared
from .features import build_features, not_features, variant

#: What one would train on a large panel, and what the queries train so that they end soon on small ones.
FULL = bo.Settings(iterations=300, rate=0.05, depth=8, leaves=31, min_rows=50, l2=1.0)
QUICK = bo.Settings(iterations=8, rate=0.4, depth=4, leaves=12, min_rows=30, l2=1.0)
#: (rate, iterations, depth, least rows, l2) of the settings that are searched.
GRID = {
    "now": (0.05, 300, 8, 50, 1.0), "slow": (0.03, 500, 8, 50, 1.0), "shallow": (0.05, 300, 4, 50, 1.0), "deep": (0.05, 300, 12, 50, 1.0),
    "wide_leaves": (0.05, 300, 8, 100, 1.0), "fine_leaves": (0.05, 300, 8, 20, 1.0), "strong_l2": (0.05, 300, 8, 50, 5.0), "no_l2": (0.05, 300, 8, 50, 0.0),
    "fast": (0.1, 150, 8, 50, 1.0), "deep_regular": (0.05, 300, 10, 100, 2.0),
}
#: Ranges of outage-rate factors to compare, and members of each; seeds of the learning curve's members; the seed of a reference draw.
RANGES, RANGE_MEMBERS, CURVE, REFERENCE = [(0.5, 1.5), (0.5, 2.5), (1.0, 3.0)], 3, tuple(range(42, 57)), (1000, 1.0)
FOLDS, SIZE, INNER, BINS = 5, 4.0, 0.15, 32
#: What judges a model, and what stops it, by name: what a row is told by, and a table of that with fold, role and stop.
ROLES = {
    "temporal": (lambda: F.col("time"), "time", lambda whole: fo.temporal_roles(whole.where("is_train"), FOLDS, INNER)),
    "spatial": (lambda: fo.block(size=SIZE), "block", lambda whole: fo.spatial_roles(whole, FOLDS, SIZE, INNER)),
}


def drawn_features(spark, d, members: list[tuple[int, float]], path: str, gap=()) -> tuple[DataFrame, list[str]]:
    """All features of the panel once for each member's outage draw (column ``draw``), written; and their names. ``gap``: months that are missing in all."""
    rows = ou.mask_months(panel(spark, d), gap) if gap else panel(spark, d)
    rows.write.parquet(f"{path}-panel")
    rows = spark.read.parquet(f"{path}-panel")
    months = ou.train_months(rows)
    gaps = {k: ou.draw_months(months, ou.scaled(RATES, factor), np.random.default_rng(seed)) for k, (seed, factor) in enumerate(members)}
    plain, spec = ou.many_draws(rows, gaps)
    order = build_features(plain, spec).columns  # ties between features go to the first
    rd.drawn_features(rows, gaps).select(*order).write.parquet(path)
    table = spark.read.parquet(path)
    return table, feature_columns(table, not_features(spec))


def _known(table: DataFrame) -> DataFrame:
    return table.where("is_train AND target IS NOT NULL")


def _whole(table: DataFrame) -> DataFrame:
    """The panel's cells and months, from the stored features of its first draw."""
    return table.where("draw = 0").select(*ID, "is_train")


def _local(df: DataFrame) -> DataFrame:
    """A small table, computed once; to be broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1))


def with_roles(table: DataFrame, *schemes: str) -> tuple[DataFrame, DataFrame]:
    """Train rows with a target that have a part in a scheme, once each, with ``part``: the number of a set of parts; and the sets.

    These are a small table of ``part`` and ``parts``, an array of (scheme, fold, role, stop). Months or blocks of one role have
    one number, so a row only carries a number, and no array is made or read for each of millions of rows.
    """
    rows, number, every = _known(table), F.lit(0), [()]
    for s in schemes:
        told, key, roles = ROLES[s]
        held: dict = {}
        for r in roles(_whole(table)).collect():  # a row a month or block, and fold
            held.setdefault(r[key], []).append((r["fold"], r["role"], r["stop"]))
        kinds = sorted({tuple(sorted(v)) for v in held.values()})
        places = {v: k for k, v in enumerate(kinds, 1)}  # 0: none
        own = table.sparkSession.createDataFrame([(k, places[tuple(sorted(v))]) for k, v in held.items()], f"_key_{s} {'date' if key == 'time' else 'string'}, _kind_{s} int").coalesce(1)
        rows = rows.withColumn(f"_at_{s}", told()).join(F.broadcast(own), F.col(f"_at_{s}") == F.col(f"_key_{s}"), "left")
        number = number * (len(kinds) + 1) + F.coalesce(f"_kind_{s}", F.lit(0))
        every = [(*a, *[(s, *p) for p in b]) for a in every for b in ((), *kinds)]
    sets = table.sparkSession.createDataFrame([(k, list(v)) for k, v in enumerate(every) if v], "part int, parts array<struct<scheme:string,fold:int,role:string,stop:boolean>>")
    return rows.withColumn("part", number).where("part > 0").select(*table.columns, "part"), sets.coalesce(1)


def parts_of(rows: DataFrame, sets: DataFrame, role: str, *keep: str) -> DataFrame:
    """Columns ``keep`` of the rows with a role, once for each part, beside the part's own columns."""
    keys = [c for c in sets.columns if c != "parts"]
    own = _local(sets.select(*keys, F.explode(F.filter("parts", lambda p: p["role"] == role)).alias("_p")))
    return rows.join(own, keys).select(*keep, "_p.*")


def fit_all(rows: DataFrame, sets: DataFrame, names: list[str], kinds: dict[str, bo.Settings], path: str, by: dict[str, list], keep: list[str]) -> tuple[DataFrame, bo.Boosted]:
    """Rows to be judged (columns ``keep``, those of their parts) with each kind's prediction, and the models: one for each kind and value of ``by``.

    ``sets`` is a small table of ``parts``, an array of structs with role (fit or val), stop, and those names of ``by`` that aren't
    columns; its other columns tell which rows have them. Rows that a model is stopped by are fitted on by models that don't stop.
    A row is stored once, however many models it is in, and which these are is found once for each set.
    """
    fields = [f.name for f in sets.schema["parts"].dataType.elementType.fields]
    size = 1
    for values in by.values():
        size *= len(values)
    for c in by:
        if c not in fields and c not in sets.columns:
            sets = sets.withColumn(c, F.explode(F.array(*[F.lit(v) for v in by[c]])))
    keys = [c for c in sets.columns if c != "parts"]

    def models(part) -> list:
        """(model, stop, kind) of a part, for each kind."""
        number = F.lit(0)
        for c, values in by.items():
            number = number * len(values) + F.array_position(F.array(*[F.lit(v) for v in values]), part[c] if c in fields else F.col(c)).cast("int") - 1
        return [F.struct((number * len(kinds) + k).cast("int").alias("model"), (part["stop"] & F.lit(bool(s.patience))).alias("stop"), F.lit(n).alias("kind"), part.alias("part")) for k, (n, s) in enumerate(kinds.items())]

    def of(role: str) -> DataFrame:
        mine = F.filter("parts", lambda p: p["role"] == role)
        return _local(sets.select(*keys, F.flatten(F.transform(mine, lambda p: F.array(*models(p)))).alias("_in")).where("size(_in) > 0"))

    settings = {m: s for n in range(size) for m, s in ((n * len(kinds) + k, s) for k, s in enumerate(kinds.values()))}
    fit = rows.join(_local(of("fit").select(*keys, F.col("_in.model").alias("model"), F.col("_in.stop").alias("_stop"))), keys)
    fitted = bo.fit_boosted(fit.select("target", *names, "model", "_stop"), names, "target", settings, path, stop="_stop", bins=BINS)
    judges = of("val")
    val = rows.join(_local(judges.select(*keys, F.col("_in.model").alias("model"))), keys)
    judged = fitted.predict(val, keep=list(dict.fromkeys([*keep, *keys])))
    told = _local(judges.select(*keys, F.posexplode("_in").alias("_at", "_one")))
    judged = judged.select("*", F.posexplode("prediction").alias("_at", "_value")).join(told, [*keys, "_at"])
    return judged.select(*keep, *[F.col(f"_one.part.{c}").alias(c) for c in fields if c not in keep], F.col("_one.kind").alias("kind"), F.col("_one.model").alias("model"), F.col("_value").alias("prediction")), fitted


def _summary(per_fold: DataFrame, *by: str) -> DataFrame:
    return ev.fold_summary(per_fold, *by).select(*by, *[_r(f"{m}_{s}", 3) for m in ("mae", "rmse", "r2") for s in ("mean", "std")])


@query()
def fitted_by_scheme(spark, d):
    """Two formulas and two fitted baselines under temporal and spatial folds; the one of absolute loss stops on an inner holdout."""
    path = shared(spark, "schemes")
    table, names = drawn_features(spark, d, [(42, 0.0)], f"{path}/features", GAP)
    rows, sets = with_roles(table, *ROLES)
    kinds = {"boosted": QUICK, "boosted_absolute": replace(QUICK, loss="l1", patience=3)}
    judged, _ = fit_all(rows, sets, names, kinds, f"{path}/fit", {"scheme": list(ROLES), "fold": list(range(FOLDS))}, ["target"])
    fitted = judged.select("scheme", "fold", F.col("kind").alias("model"), "target", "prediction")
    plain = parts_of(rows, sets, "val", "target", "climatology_mean", "last_observed")
    plain = plain.select("scheme", "fold", "target", ev.persistence().alias("persistence"), F.coalesce("climatology_mean", F.col("last_observed").cast("double")).alias("climatology"))
    formulas = plain.unpivot(["scheme", "fold", "target"], ["persistence", "climatology"], "model", "prediction")
    return fitted.unionByName(formulas).groupBy("scheme", "model", "fold").agg(*ev.metrics("target", "prediction"))


def _bag(judged: DataFrame, *by: str) -> DataFrame:
    """Metrics by fold of the mean over draws of each row's predictions."""
    means = judged.groupBy(*by, "fold", *ID).agg(F.avg("prediction").alias("prediction"), F.first("target").alias("target"))
    return means.groupBy(*by, "fold").agg(*ev.metrics("target", "prediction"))


@query()
def bagged_by_scheme(spark, d):
    """A bag of members, each fitted and judged on the features of its own outage draw, under both schemes."""
    path = shared(spark, "bag")
    table, names = drawn_features(spark, d, MEMBERS, f"{path}/features")
    by = {"scheme": list(ROLES), "fold": list(range(FOLDS)), "draw": list(range(len(MEMBERS)))}
    judged, _ = fit_all(*with_roles(table, *ROLES), names, {"bag": QUICK}, f"{path}/fit", by, [*ID, "target"])
    return _summary(_bag(judged, "scheme"), "scheme")


@query()
def rate_ranges_fitted(spark, d):
    """Bags whose members' outage rates come from one range of factors each, compared under temporal folds."""
    path = shared(spark, "ranges")
    members = [(42 + k, f) for low, high in RANGES for k, f in enumerate(ou.multipliers(low, high, RANGE_MEMBERS))]
    table, names = drawn_features(spark, d, members, f"{path}/features")
    judged, _ = fit_all(*with_roles(table, "temporal"), names, {"bag": QUICK}, f"{path}/fit", {"fold": list(range(FOLDS)), "draw": list(range(len(members)))}, [*ID, "target", "draw"])
    label = F.array(*[F.lit(f"{low}-{high}") for low, high in RANGES])[F.floor(F.col("draw") / RANGE_MEMBERS).cast("int")]
    return _summary(_bag(judged.withColumn("range", label), "range"), "range")


@query()
def neighbours_fitted(spark, d):
    """Bags with and without the neighbours' features, trained by the same jobs."""
    path = shared(spark, "near")
    table, names = drawn_features(spark, d, MEMBERS[:2], f"{path}/features")
    kinds = {"with": QUICK, "without": replace(QUICK, features=tuple(variant(names, "no_neighbours")))}
    judged, _ = fit_all(*with_roles(table, "temporal"), names, kinds, f"{path}/fit", {"fold": list(range(FOLDS)), "draw": [0, 1]}, [*ID, "target"])
    return _summary(_bag(judged, "kind"), "kind")


@query()
def member_by_horizon_fitted(spark, d):
    """Each fitted member's error where the month is seen and where it is masked, on one reference draw for all."""
    path = shared(spark, "horizon")
    table, names = drawn_features(spark, d, [*MEMBERS, REFERENCE], f"{path}/features")
    part = lambda p, member: F.struct(member.alias("member"), *[p[c].alias(c) for c in ("fold", "role", "stop")])
    own = F.transform(F.filter("parts", lambda p: p["role"] == "fit"), lambda p: part(p, F.col("draw")))
    same = F.transform(F.filter("parts", lambda p: p["role"] == "val"), lambda p: F.array(*[part(p, F.lit(k)) for k in range(len(MEMBERS))]))
    rows, sets = with_roles(table, "temporal")
    sets = sets.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(len(MEMBERS))))).withColumn("parts", F.when(F.col("draw") < len(MEMBERS), own).otherwise(F.flatten(same)))
    judged, _ = fit_all(rows, sets, names, {"member": QUICK}, f"{path}/fit", {"fold": list(range(FOLDS)), "member": list(range(len(MEMBERS)))}, ["target", "masked"])
    e = F.abs(F.col("target") - F.col("prediction"))
    per = judged.groupBy("member", "fold").agg(F.avg(F.when(~F.col("masked"), e)).alias("seen"), F.avg(F.when(F.col("masked"), e)).alias("hidden"), F.count_if("masked").alias("n_hidden"))
    return per.groupBy("member").agg(F.round(F.avg("seen"), 3).alias("mae_seen"), F.round(F.avg("hidden"), 3).alias("mae_hidden"), F.sum("n_hidden").alias("n_hidden"))


@query()
def member_curve(spark, d):
    """Error and task seconds of the first N fitted members, N = 1 to 15: each row's running mean, and each fold's running sum of seconds."""
    path = shared(spark, "curve")
    table, names = drawn_features(spark, d, [(s, 1.0) for s in CURVE], f"{path}/features")
    by = {"fold": list(range(FOLDS)), "draw": list(range(len(CURVE)))}
    judged, fitted = fit_all(*with_roles(table, "temporal"), names, {"member": replace(QUICK, iterations=4)}, f"{path}/fit", by, [*ID, "target", "draw"])
    curve = ev.ensemble_curve(judged.withColumn("member", F.col("draw")), "fold", *ID)
    per = curve.groupBy("fold", "n_models").agg(*ev.metrics("target", "prediction"))
    took = spark.createDataFrame([(m // len(CURVE), m % len(CURVE) + 1, s) for m, s in sorted(fitted.seconds.items())], "fold int, n_models int, seconds double")
    upto = Window.partitionBy("fold").orderBy("n_models").rowsBetween(Window.unboundedPreceding, 0)
    both = per.join(F.broadcast(took.withColumn("seconds", F.sum("seconds").over(upto))), ["fold", "n_models"])  # a row a model
    return both.groupBy("n_models").agg(F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("mae_std"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"), F.avg("seconds").alias("seconds"))


def grid_settings() -> dict[str, bo.Settings]:
    """The settings that are searched."""
    return {n: bo.Settings(it, rate, depth, 31, rows, l2) for n, (rate, it, depth, rows, l2) in GRID.items()}


@query()
def hyperparameter_grid(spark, d):
    """All ten settings under temporal folds, whole: each with its own iterations, rate and depth, by the jobs of one."""
    path = shared(spark, "grid")
    table, names = drawn_features(spark, d, [(42, 1.0)], f"{path}/features")
    judged, _ = fit_all(*with_roles(table, "temporal"), names, grid_settings(), f"{path}/fit", {"fold": list(range(FOLDS))}, ["target"])
    per = judged.groupBy(F.col("kind").alias("setting"), "fold").agg(*ev.metrics("target", "prediction"))
    return _summary(per, "setting")


def _holdout(spark, d, path: str, members: list[tuple[int, float]], gap=()) -> tuple[DataFrame, DataFrame, list[str]]:
    table, names = drawn_features(spark, d, members, path, gap)
    rows = fo.with_time_folds(_known(table), _local(fo.two_tier_split(_whole(table).where("is_train"))))
    sets = spark.createDataFrame([(r, [("val" if r == "outer_val" else "fit", r == "inner_val")]) for r in ("fit", "inner_val", "outer_val")], "part string, parts array<struct<role:string,stop:boolean>>")
    return rows.withColumnRenamed("role", "part"), sets.coalesce(1), names


@query()
def bagged_predictions(spark, d):
    """The mean of members fitted on the features of their own draws, for the last months."""
    path = shared(spark, "bagged")
    rows, sets, names = _holdout(spark, d, f"{path}/features", MEMBERS)
    judged, _ = fit_all(rows, sets, names, {"bag": QUICK}, f"{path}/fit", {"draw": list(range(len(MEMBERS)))}, ID)
    return ev.ensemble_mean(judged, *ID)


@query()
def early_stopped_forecast(spark, d):
    """Trees of absolute loss that stop on an inner holdout of months and are judged on the months after it."""
    path = shared(spark, "stopped")
    rows, sets, names = _holdout(spark, d, f"{path}/features", [(42, 0.0)], GAP)
    judged, _ = fit_all(rows, sets, names, {"stopped": replace(QUICK, iterations=20, loss="l1", patience=4)}, f"{path}/fit", {"draw": [0]}, [*ID, "target"])
    return judged.select(*ID, "target", "prediction")


@query()
def permutation_importance(spark, d):
    """What each of all features is worth on the last months, its values dealt anew over all of them."""
    path = shared(spark, "importance")
    rows, sets, names = _holdout(spark, d, f"{path}/features", [(42, 0.0)], GAP)
    judged, fitted = fit_all(rows, sets, names, {"one": QUICK}, f"{path}/fit", {"draw": [0]}, [*ID, *names, "target"])
    judged.drop("prediction").write.parquet(f"{path}/val")
    return fc.permutation_importance(lambda df: fitted.predict(df, 0), spark.read.parquet(f"{path}/val"), names, ID)


@query()
def starter_baseline(spark, d):
    """Persistence against trees with and without the coordinates among the features, the last fifth of the months; and each one's gain."""
    path = shared(spark, "starter")
    table, names = drawn_features(spark, d, [(42, 0.0)], f"{path}/features", GAP)
    plain, placed = fc.projected(table, names), fc.projected(table, names, use_position=True)
    rows = fo.with_time_folds(_known(table), _local(fo.temporal_holdout(_whole(table).where("is_train"), 0.2)))
    rows = rows.withColumnRenamed("role", "part")
    sets = spark.createDataFrame([(r, [(r, False)]) for r in ("fit", "val")], "part string, parts array<struct<role:string,stop:boolean>>").coalesce(1)
    kinds = {"trees": replace(QUICK, features=tuple(plain)), "trees_with_position": replace(QUICK, features=tuple(placed))}
    judged, _ = fit_all(rows, sets, placed, kinds, f"{path}/fit", {"draw": [0]}, ["target"])
    every = judged.select(F.col("kind").alias("model"), "target", "prediction").unionByName(parts_of(rows, sets, "val", "target", "last_observed", "climatology_mean").select(F.lit("persistence").alias("model"), "target", ev.persistence().alias("prediction")))
    found = every.groupBy("model").agg(*ev.metrics("target", "prediction"))
    return found.join(F.broadcast(ev.metric_gains(found, "model", "persistence")), "model", "left")  # three rows


@query()
def final_predictions_fitted(spark, d):
    """The predictions file of fitted members: trained on all train rows of their own draws, predicting test rows of the plain history."""
    path = shared(spark, "final")
    table, names = drawn_features(spark, d, [*MEMBERS, (0, 0.0)], f"{path}/features")
    key = F.concat_ws("_", F.date_format("time", "yyyyMMdd"), (F.col("lat") * 10).cast("int"), F.col("lon").cast("int")).alias("ID")
    rows = _known(table).where(f"draw < {len(MEMBERS)}").withColumn("member", F.col("draw"))
    fitted = bo.fit_boosted(rows, names, "target", {k: QUICK for k in range(len(MEMBERS))}, f"{path}/fit", model="member")
    test = table.where(f"NOT is_train AND draw = {len(MEMBERS)}")
    ids = panel(spark, d).where("NOT is_train").select(key)
    out = None
    for k, (seed, factor) in enumerate(MEMBERS):
        own = src.member_predictions(spark, f"{path}/members", seed, factor, lambda k=k: fitted.predict(test, k, keep=ID).select(key, "prediction"), ids, str(QUICK))
        out = own if out is None else out.unionByName(own)
    template = ids.withColumn("place", F.col("ID"))
    src.write_predictions(ev.template_join(template, ev.ensemble_mean(out, "ID"), "ID").withColumnRenamed("prediction", "Target"), f"{path}/predictions.csv")
    return src.scan_csv(spark, f"{path}/predictions.csv", "ID string, Target string")

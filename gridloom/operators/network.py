"""A small neural network on the panel's features, trained by averaging.

Every epoch has its own training table, such as a new outage draw. Rows are dealt to shards of about ``SHARD_ROWS`` by a
hash of what they hold and sorted by it, so a shard has the same rows in the same order whatever the files or tasks.
Each shard walks its rows once, starting from the epoch's weights; weights are added up by rows, as whole multiples of
``GRAIN``, so the order of tasks doesn't matter either, and the driver only ever holds one model.

NULL features take the medians of the first epoch's table, whose means and deviations also scale features and target.
Training stops when the smoothed error on ``val`` no longer falls, and the best epoch's weights are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import medians, smoothed_stop
from .panel import PANEL, PanelSpec

#: Rows of a step, and of a shard, about.
BATCH, SHARD_ROWS = 256, 1 << 16
#: Weights are averaged as multiples of this, and what scales columns has so many digits.
GRAIN, DIGITS = 2.0**-40, 9


def settled(x: float | None) -> float | None:
    """A number without the digits that the order of sums can change."""
    return None if x is None else float(f"{x:.{DIGITS}g}")


def start_weights(sizes: list[int], seed: int) -> np.ndarray:
    """One flat vector: for each layer its matrix, then its offsets."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])


def layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, weights: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The input and each layer's output; all layers but the last are rectified."""
    out = [x]
    for k, (w, b) in enumerate(layers(weights, sizes)):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if k < len(sizes) - 2 else z)
    return out


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: list[int], decay: float) -> np.ndarray:
    """Of half the mean squared error, with a penalty on the weights."""
    seen, parts = forward(x, weights, sizes), []
    delta = (seen[-1][:, 0] - y)[:, None] / len(y)
    for k, (w, _) in reversed(list(enumerate(layers(weights, sizes)))):
        parts.append(np.concatenate([(seen[k].T @ delta).ravel(), delta.sum(axis=0)]))
        delta = (delta @ w.T) * (seen[k] > 0)
    return np.concatenate(parts[::-1]) + decay * weights


def _walk(weights: np.ndarray, sizes: list[int], rate: float, decay: float, seed: int, batch_rows: int) -> Callable:
    """A shard's rows (sorted, of one shard after the other in a task) trained on; (place, w, n): weights times rows in grains, and rows."""

    def trained(x: np.ndarray, y: np.ndarray, shard: int) -> np.ndarray:
        own, m, v = weights.copy(), np.zeros_like(weights), np.zeros_like(weights)
        order = np.random.default_rng([seed, shard]).permutation(len(y))
        for step, at in enumerate(range(0, len(y), batch_rows), 1):
            some = order[at : at + batch_rows]
            g = gradient(x[some], y[some], own, sizes, decay)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            own -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(weights), object), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = -1

        def close() -> None:
            nonlocal rows, held
            if held:
                x, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
                total[:] += np.rint(trained(x, y, now) / GRAIN).astype(np.int64).astype(object) * len(y)
                rows += len(y)
            held = []

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, sizes[0])
            y = batch.column("y").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(y)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if shards[a] != now:
                        close()
                        now = int(shards[a])
                    held.append((x[a:b], y[a:b]))
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([str(v) for v in total]), pa.array(np.full(len(total), rows), pa.int64())], ["place", "w", "n"])

    return run


@dataclass
class Network:
    """Weights and what scales features and target."""

    features: list[str]
    sizes: list[int]
    weights: np.ndarray
    middle: dict[str, float]
    scale: dict[str, tuple[float, float]]
    target: str
    errors: list[float]

    def inputs(self) -> Column:
        """Features as an array: medians for NULLs, then scaled."""
        one = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(self.middle[c])) - self.scale[c][0]) / self.scale[c][1]
        return F.array(*[one(c) for c in self.features])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (one that it has is replaced)."""
        weights, sizes, (mean, deviation) = self.weights, self.sizes, self.scale[self.target]

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(forward(np.stack(x), weights, sizes)[-1][:, 0] * deviation + mean) if len(x) else pd.Series([], dtype=float)

        return df.drop("prediction").withColumn("prediction", scored(self.inputs()))


def fit_network(
    draws: Callable[[int], DataFrame], val: DataFrame, features: list[str], spec: PanelSpec = PANEL,
    hidden: tuple[int, ...] = (128, 64, 32), epochs: int = 150, patience: int = 20, rate: float = 1e-3, decay: float = 1e-4, seed: int = 42, batch_rows: int = BATCH,
) -> Network:
    """A network trained on ``draws(epoch)``, a table for each epoch, and stopped by its mean absolute error on ``val``.

    Rows without a target don't count; a feature that is NULL throughout is 0; without any row to learn from a ValueError says so.
    """
    target = spec.target
    known = lambda df: df.where(F.col(target).isNotNull())
    first = known(draws(0))
    middle = {c: settled(m) or 0.0 for c, m in medians(first, *features).first().asDict().items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in features} | {target: F.col(target).cast("double")}
    stats = first.agg(*[f(x).alias(f"{n}_{c}") for c, x in filled.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if stats[f"m_{target}"] is None:
        raise ValueError("no row has a target to learn from")
    scale = {c: (settled(stats[f"m_{c}"]), settled(stats[f"s_{c}"]) or 1.0) for c in filled}
    sizes = [len(features), *hidden, 1]
    net = Network(list(features), sizes, start_weights(sizes, seed), middle, scale, target, [])
    shards = max(1, first.count() // SHARD_ROWS)
    kept: dict[int, np.ndarray] = {}
    for epoch in range(epochs):
        rows = known(draws(epoch)).select(net.inputs().alias("x"), ((F.col(target).cast("double") - scale[target][0]) / scale[target][1]).alias("y"))
        rows = rows.withColumn("h", F.xxhash64("x", "y")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "y", "x").select("shard", "x", "y")
        walked = dealt.mapInArrow(_walk(net.weights, sizes, rate, decay, seed + epoch, batch_rows), "place int, w string, n long")
        found = walked.groupBy("place").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()  # a row a weight
        if found:
            net.weights = np.array([int(r.w) / r.n * GRAIN for r in sorted(found)])
        error = net.predict(known(val)).agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0]
        net.errors.append(float("inf") if error is None else settled(error))
        kept[epoch] = net.weights
        best = max(smoothed_stop(net.errors, patience), 0)
        kept = {k: w for k, w in kept.items() if k >= best}
        if epoch - best >= patience:
            break
    net.weights = kept[best]
    return net

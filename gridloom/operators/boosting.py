"""Boosted regression trees for many models at once, grown from histograms that Spark adds up.

A model is a number in the training table: a bag's member, a fold, a setting, a feature set. All of them are trained by
the same jobs, so their number doesn't change the number of jobs: one for each level of a tree, and one more for leaf
values under absolute loss. Each job takes every model one level on in its own tree, so none waits for deeper or more ones.

A row can be in many models (a fold's, a setting's): it is stored once, with the set of its models, and its bins are read
once for all of them. Rows of a set lie together, ``PACK`` in a record, column by column.

Features are binned once, by cuts of an approximate quantile sketch over the rows to fit on; NULL and NaN have a bin of
their own and go to the side of a split that gains more, so nothing is imputed. Each level is one aggregate: tasks sum
gradients and rows by (model, node, feature, bin) over their rows and send a block of sums a node, one exchange brings a
node's blocks together, and running sums over the bins give its best split; a row a node, and a row a set of models, reach the
driver. Trees are pruned to ``leaves`` by gain, best first, which is what growth by the best leaf gives under a limit of depth,
without a job a leaf; nodes that this can't reach any more are not summed, so a level has fewer than twice ``leaves``, however deep.

Every ``KEEP`` trees the rows' predictions are written beside them, so a pass walks few trees, lineage stays short and a
lost executor costs its tasks; the writing before goes then. Between these, passes read rows from Spark's cache. The driver holds trees: models * iterations * leaves nodes.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a stored record, records of a batch, and rows of a part, about: few where there are few.
PACK, RECORDS, LEAST_ROWS, PART_ROWS = 256, 256, 1 << 12, 1 << 18
#: Nodes whose sums one task adds up, about.
NODES = 48
#: Share of a gain that rounding may take.
TIE = 1e-10
#: Rows that a task of the quantile sketch sorts at once.
SKETCH_ROWS = 1 << 17
#: Trees between two writings of the rows' predictions, in the mean over models; each of a tree's passes walks those since then.
KEEP = 4


@dataclass(frozen=True)
class Settings:
    """``patience`` trees without a better error on the rows held back end a model (0: never); ``features`` None means all."""

    iterations: int = 300
    rate: float = 0.05
    depth: int = 8
    leaves: int = 31
    min_rows: int = 50
    l2: float = 1.0
    loss: str = "l2"
    patience: int = 0
    features: tuple[str, ...] | None = None


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf, else rows with a bin up to ``cut`` go to ``left``, and missing ones if ``missing``."""

    feature: np.ndarray
    cut: np.ndarray
    missing: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __reduce__(self):
        """Sent as one line of bytes, since tasks get thousands of trees."""
        return _unpacked, (np.rec.fromarrays([self.feature, self.cut, self.missing, self.left, self.right, self.value], _NODE).tobytes(),)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        return self.reached(np.asarray(codes, np.uint8).T)

    def reached(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of each row, from a line of bins for each feature: whole lines are compared, once a node."""
        small = len(self.feature) <= 256
        out = np.zeros(columns.shape[1], np.uint8 if small else np.int32)
        at = {0: np.ones(columns.shape[1], bool)}
        for n, f in enumerate(self.feature.tolist()):  # parents come before their children
            here = at.pop(n)
            if f >= 0:
                left = _goes_left(columns[f], int(self.cut[n]), bool(self.missing[n]))
                at[int(self.left[n])], at[int(self.right[n])] = here & left, here > left
            elif n:
                out |= here.view(np.uint8) * np.uint8(n) if small else here * np.int32(n)
        return out


_NODE = np.dtype([("feature", "<i4"), ("cut", "<i4"), ("missing", "?"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8")])


def _unpacked(nodes: bytes) -> Tree:
    read = np.frombuffer(nodes, _NODE)
    return Tree(*[np.ascontiguousarray(read[c]) for c in _NODE.names])


def _goes_left(bins: np.ndarray, cut: int, missing: bool) -> np.ndarray:
    """Which bins lie up to a cut; bin 0, of missing values, if ``missing``."""
    return bins <= cut if missing else (bins - np.uint8(1)) < cut  # 0 - 1 is 255


@dataclass
class Boosted:
    """Fitted models by number, with each one's errors on the rows held back and seconds of task time."""

    features: list[str]
    cuts: list[np.ndarray]
    settings: dict[int, Settings]
    base: dict[int, float]
    trees: dict[int, list[Tree]]
    errors: dict[int, list[float]] = field(default_factory=dict)
    seconds: dict[int, float] = field(default_factory=dict)

    def scores(self, model: int, columns: np.ndarray) -> np.ndarray:
        """A model's predictions from a line of bins for each feature."""
        return _plus(np.full(columns.shape[1], self.base[model]), self.trees[model], columns)

    def predict(self, df: DataFrame, model: str | int = "model", out: str = "prediction", keep: list[str] | None = None) -> DataFrame:
        """``df`` (its columns ``keep``, or all) with predictions (replaced if there) of the model that each row names, or of one; NULL for a number that wasn't fitted.

        A column of arrays names several models a row; predictions are arrays then.
        """
        plain = df.drop(out)
        kept = plain.columns if keep is None else keep
        many = isinstance(model, str) and isinstance(df.schema[model].dataType, ArrayType)
        number = F.array(F.lit(model)) if not isinstance(model, str) else F.col(model) if many else F.array(model)
        names = [f"_x{k}" for k in range(len(self.features))]
        ready = plain.select(*kept, number.cast("array<int>").alias("_m"), *[F.col(c).cast("double").alias(n) for c, n in zip(self.features, names, strict=True)])
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = sent.value
            for batch in batches:
                columns, lists = binned(batch, names, fitted.cuts), batch.column("_m")
                models, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at, found = np.repeat(np.arange(batch.num_rows), sizes), np.full(len(models), np.nan)
                for m in fitted.trees:
                    mine = np.flatnonzero(models == m)
                    if len(mine):
                        found[mine] = fitted.scores(m, columns if len(mine) == columns.shape[1] == len(at) else columns[:, at[mine]])
                made = pa.array(found, pa.float64(), mask=np.isnan(found))
                if many:
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), made)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, out])

        types = dict(plain.dtypes)
        return ready.mapInArrow(run, "".join(f"`{n}` {types[n]}, " for n in kept) + f"`{out}` {'array<double>' if many else 'double'}")


def binned(batch: pa.RecordBatch, columns: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """A line of bins, a byte each, for each feature: 0 for missing, else 1 + the cuts below the value."""
    out = np.zeros((len(columns), batch.num_rows), np.uint8)
    for k, (c, at) in enumerate(zip(columns, cuts, strict=True)):
        x = batch.column(c).to_numpy(zero_copy_only=False)
        out[k] = np.where(np.isnan(x), 0, np.searchsorted(at, x, "left") + 1)
    return out


def _points(names: list[str], most: int) -> Callable:
    """Of some 100,000 rows at a time: at most ``most`` values a feature that stand for equal weights, and those weights."""

    def thinned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.sort(x)
        ranks = np.arange(1, len(x) + 1) if len(x) <= most else np.unique(np.ceil(len(x) * np.arange(1, most + 1) / most).astype(np.int64))
        return x[ranks - 1], np.diff(ranks, prepend=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            n = np.concatenate([b.column("_n").to_numpy(zero_copy_only=False) for b in held])
            for k, c in enumerate(names):
                x = np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
                for w in np.unique(n).tolist():  # rows of one weight need no weights to be sorted; they are few: a row's numbers of models
                    own = x[n == w]
                    value, times = thinned(own[~np.isnan(own)])
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k), pa.int32()), pa.array(value), pa.array((times * w).astype(np.int64))], ["feature", "x", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SKETCH_ROWS:
                yield from close()
                held, rows = [], 0
        if held:
            yield from close()

    return run


def sketched_cuts(df: DataFrame, features: list[str], bins: int, weight: str | None = None) -> list[np.ndarray]:
    """At most ``bins - 1`` distinct cuts a feature, from one pass; a row counts ``weight`` (a whole number) times.

    Tasks thin stretches of rows to weighted values, ranks off by a ``20 * bins``-th at most; running sums over these give the cuts.
    """
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    narrow = df.select(n.alias("_n"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(features)]).where("_n > 0")
    points = narrow.mapInArrow(_points([f"_{k}" for k in range(len(features))], 20 * bins), "feature int, x double, n long")
    points = points.groupBy("feature", "x").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("feature")
    ranked = points.withColumns({"_upto": F.sum("n").over(own.orderBy("x")), "_all": F.sum("n").over(own)})
    at = [F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * k / bins) - 1), F.col("x"))) for k in range(1, bins)]
    found = {r[0]: r[1] for r in ranked.groupBy("feature").agg(F.array(*at)).collect()}  # a row a feature
    return [np.unique(np.array(found.get(k, []), dtype=np.float64)) for k in range(len(features))]


@dataclass
class _Growing:
    """One model's tree in the making: splits by node, numbered as in a heap."""

    number: int
    settings: Settings
    columns: np.ndarray
    trees: list[Tree]
    splits: dict[int, tuple] = field(default_factory=dict)
    live: list[int] = field(default_factory=lambda: [0])
    level: int = 0
    done: bool = False

    def sent(self) -> _Growing:
        """What tasks read of it: the splits above the live nodes."""
        above = {n for n in self.live if n}
        for _ in range(self.level):
            above |= {(n - 1) // 2 for n in above if n}
        return replace(self, splits={n: self.splits[n][:4] for n in above - set(self.live)})

    def at(self, columns: np.ndarray) -> np.ndarray:
        """The place among ``live`` of each row's node at its level; -1 where its node is none of them. ``columns``: a line of bins for each feature."""
        rows, level = columns.shape[1], self.level
        size = 2**level - 1
        above = sorted(n for n in self.splits if n < size)
        if len(above) <= 64:  # whole lines are compared, once a node
            live, out = {n: k for k, n in enumerate(self.live)}, np.full(rows, -1, np.int32)
            nodes = {0: np.ones(rows, bool)}
            for n in above:
                here = nodes.pop(n, None)
                if here is not None:
                    left = _goes_left(columns[self.splits[n][1]], self.splits[n][2], self.splits[n][3])
                    nodes[2 * n + 1], nodes[2 * n + 2] = here & left, here > left
            for n, here in nodes.items():
                if n in live:
                    np.putmask(out, here, live[n])
            return out
        node, every = np.zeros(rows, np.int64), np.arange(rows)
        feature, cut, missing = np.full(size + 1, -1), np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
        for n in above:
            feature[n], cut[n], missing[n] = self.splits[n][1:4]
        for _ in range(level):
            f = np.where(node >= 0, feature[np.maximum(node, 0)], -1)
            code = columns[np.maximum(f, 0), every]
            left = np.where(code == 0, missing[np.maximum(node, 0)], code <= cut[np.maximum(node, 0)])
            node = np.where(f >= 0, 2 * node + np.where(left, 1, 2), -1)
        place = np.full(2 ** (level + 1), -1)
        place[np.array(self.live, dtype=np.int64)] = np.arange(len(self.live))
        return np.where(node >= 0, place[np.maximum(node, 0)], -1)

    def chosen(self) -> list[int]:
        """Nodes in the order in which growth by the best leaf splits them, as far as splits are known."""
        chosen, heap = [], [(-self.splits[0][0], 0)] if 0 in self.splits else []
        while heap and len(chosen) < self.settings.leaves - 1:
            _, n = heapq.heappop(heap)
            chosen.append(n)
            for child in (2 * n + 1, 2 * n + 2):
                if child in self.splits:
                    heapq.heappush(heap, (-self.splits[child][0], child))
        return chosen

    def descend(self) -> None:
        """Down a level, to the nodes that can still be split.

        Children come after their parent, and what is found below only puts known nodes further back in the order; so nodes that
        are not chosen now, or are the last one that can be, have no children that will be.
        """
        least, able = 2 * self.settings.min_rows, set(self.chosen()[: max(0, self.settings.leaves - 2)])
        parents = [(n, self.splits[n]) for n in self.live if n in able]
        self.live = [c for n, s in parents for c, rows in ((2 * n + 1, s[5]), (2 * n + 2, s[7])) if rows >= least]
        self.level += 1
        self.done = not self.live or self.level >= self.settings.depth

    def grown(self) -> tuple[Tree, list[tuple[float, int]]]:
        """The tree of the best splits, and sums and rows of its nodes."""
        chosen = set(self.chosen())
        order, sums = [0], {0: (0.0, 0)}
        for n in order:
            if n in chosen:
                _, _, _, _, gl, nl, gr, nr = self.splits[n]
                order += [2 * n + 1, 2 * n + 2]
                sums[2 * n + 1], sums[2 * n + 2] = (gl, nl), (gr, nr)
        place = {n: k for k, n in enumerate(order)}
        inner = [n in chosen for n in order]
        pick = lambda f, other: np.array([f(n) if i else other for n, i in zip(order, inner, strict=True)])
        tree = Tree(
            pick(lambda n: self.splits[n][1], -1), pick(lambda n: self.splits[n][2], 0), pick(lambda n: self.splits[n][3], False).astype(bool),
            pick(lambda n: place[2 * n + 1], 0), pick(lambda n: place[2 * n + 2], 0), np.zeros(len(order)),
        )
        return tree, [sums[n] for n in order]


#: A stored record: rows of one set of models; y and f as doubles (f: a line a model), bins as a line a feature.
_STATE = "set int, y binary, f binary, bins binary"


@dataclass
class _Set:
    """Models that the same rows are in; ``stops``: whether these rows are held back from a model; ``first``: what each model starts from."""

    models: list[int]
    stops: list[bool]
    first: list[float]


def _records(numbers: list[int], ys: list, fs: list, bins: list, sets: dict[int, _Set], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(set, y, f, bins, rows of each record) of each run of records of one set among some; f has a line a model, bins a line a feature."""
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            own = sets[int(numbers[a])]
            y = [np.frombuffer(x, np.float64) for x in ys[a:b]]
            f = [np.frombuffer(x, np.float64).reshape(len(own.models), -1) if x is not None else np.repeat(np.array(own.first)[:, None], len(v), 1) for x, v in zip(fs[a:b], y, strict=True)]
            yield int(numbers[a]), np.concatenate(y), np.concatenate(f, 1), np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1) for x in bins[a:b]], 1), [len(v) for v in y]


def _of_batch(batch: pa.RecordBatch, sets: dict[int, _Set], width: int) -> Iterator:
    text = [[x.as_buffer() if x.is_valid else None for x in batch.column(c)] for c in ("y", "f", "bins")]
    return _records(batch.column("set").to_pylist(), *text, sets, width)


def _plus(f: np.ndarray, trees: list[Tree], columns: np.ndarray) -> np.ndarray:
    for tree in trees:
        f = f + tree.value[tree.reached(columns)]
    return f


#: Nodes that stand for a model's error on rows held back, and for its seconds.
_ERROR, _SECONDS = -1, -2


def _summing(plan: dict[int, _Growing], sets: dict[int, _Set], width: int, bins: int, parts: int) -> Callable:
    """A task's sums of gradients and rows by (model, node, feature, bin), for ``best_splits``; ``bins`` counts that of missing values."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        extra: dict[tuple[int, int], list[float]] = {}
        while some := list(islice(rows, RECORDS)):
            for number, y, f, columns, _ in _records(*zip(*some, strict=True), sets, width):
                for k, (m, stop) in enumerate(zip(sets[number].models, sets[number].stops, strict=True)):
                    own = plan.get(m)
                    if own is None or (stop and own.level):
                        continue
                    began = time.perf_counter()
                    rest = y - _plus(f[k], own.trees, columns)
                    if stop:
                        e = extra.setdefault((m, _ERROR), [0.0, 0])
                        e[0] += float(np.abs(rest).sum())
                        e[1] += len(rest)
                    else:
                        if m not in held:
                            shape = (len(own.columns), (len(own.live) + 1) * bins)
                            held[m] = np.zeros(shape), np.zeros(shape, np.int64)
                        _add(*held[m], own, columns, rest, bins)
                    s = extra.setdefault((m, _SECONDS), [0.0, 0])
                    s[0] += time.perf_counter() - began
        for m, sums in held.items():
            live = np.array(plan[m].live)
            g, n = (x.reshape(len(x), -1, bins)[:, :-1].swapaxes(0, 1) for x in sums)  # a node, a feature, a bin
            for part in np.unique((live + m) % parts).tolist():
                own = (live + m) % parts == part
                yield part, (m, live[own], np.ascontiguousarray(g[own]), n[own].astype(np.int32))
        for (m, kind), (total, n) in extra.items():
            yield m % parts, (m, kind, total, n)

    return run


def _add(total: np.ndarray, n: np.ndarray, own: _Growing, columns: np.ndarray, rest: np.ndarray, bins: int) -> None:
    """Adds rows to a model's sums (a line a feature; the last place stands for rows of nodes that are not split)."""
    place, some = own.at(columns), slice(None)
    alive = int((place >= 0).sum())
    if alive < 0.75 * len(place):
        some = np.flatnonzero(place >= 0)
        place, rest = place[some], rest[some]
    elif alive < len(place):
        place = np.where(place < 0, len(own.live), place)
    if len(place):
        g, first = rest if own.settings.loss == "l2" else np.sign(rest), place.astype(np.int64) * bins
        for k, c in enumerate(own.columns.tolist()):
            key = first + columns[c][some]
            total[k] += np.bincount(key, g, total.shape[1])
            n[k] += np.bincount(key, minlength=n.shape[1])


def best_splits(sums: RDD, plan: dict[int, _Growing], parts: int) -> RDD:
    """Of tasks' sums, as (part, (model, nodes, g, n)): (model, node, best split) of each node that gains by one.

    Sums of a node lie in one part; ``g`` and ``n`` have a line of bins for each node and feature. A split is (gain, feature, bin, whether
    missing rows go left, sum and rows to the left, to the right). With ``_ERROR`` or ``_SECONDS`` for nodes, ``g`` and ``n`` are numbers.
    """
    told = {m: (p.columns, p.settings.l2, p.settings.min_rows) for m, p in plan.items()}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        whole: dict[int, list] = {}
        extra: dict[tuple[int, int], list] = {}
        for _, (m, nodes, g, n) in rows:
            own = extra.setdefault((m, nodes), [0.0, 0]) if isinstance(nodes, int) else whole.get(m)
            if own is None:
                whole[m] = [g.copy(), n.astype(np.int64), nodes]
            else:
                own[0] += g
                own[1] += n
        for m, (g, n, nodes) in whole.items():
            for node, best in zip(nodes.tolist(), _best(g, n, *told[m]), strict=True):
                if best:
                    yield m, node, best
        for (m, kind), sums_ in extra.items():
            yield m, kind, tuple(sums_)

    return sums.partitionBy(parts, int).mapPartitions(run)


def _best(g: np.ndarray, n: np.ndarray, columns: np.ndarray, l2: float, min_rows: int) -> list[tuple | None]:
    """Each node's best split, None if none gains. Ties go to the first feature, the lowest bin, and missing rows to the right.

    Gains that differ by no more than sums do in another order of their rows are ties.
    """
    g_all, n_all = g.sum(2, keepdims=True), n.sum(2, keepdims=True)
    up, rows_up = np.cumsum(g[:, :, 1:], 2), np.cumsum(n[:, :, 1:], 2)
    left = np.stack([up, up + g[:, :, :1]], 3), np.stack([rows_up, rows_up + n[:, :, :1]], 3)
    right = g_all[..., None] - left[0], n_all[..., None] - left[1]
    with np.errstate(divide="ignore", invalid="ignore"):  # no rows and no penalty
        part = lambda a, b: a * a / (b + l2)
        gain = part(*left) + part(*right) - part(g_all, n_all)[..., None]
        sound = (n[:, :, 1:, None] > 0) & (left[1] >= min_rows) & (right[1] >= min_rows) & (gain > 1e-12 * (g_all * g_all)[..., None] + 1e-300)
    gain = np.where(sound, gain, 0.0).reshape(len(g), -1)
    out: list[tuple | None] = []
    for k, at in enumerate((gain >= gain.max(1, keepdims=True) * (1 - TIE)).argmax(1).tolist()):
        f, b, missing = np.unravel_index(at, sound.shape[1:])
        sides = [float(left[0][k, f, b, missing]), int(left[1][k, f, b, missing]), float(right[0][k, f, b, missing]), int(right[1][k, f, b, missing])]
        out.append((float(gain[k, at]), int(columns[f]), int(b) + 1, bool(missing), *sides) if gain[k, at] > 0 else None)
    return out


def fit_boosted(rows: DataFrame, features: list[str], target: str, settings: dict[int, Settings], path: str, model: str = "model", stop: str | None = None, bins: int = 64, cuts: list[np.ndarray] | None = None) -> Boosted:
    """All models of ``settings`` fitted on their rows of ``rows``; ``stop`` marks rows held back to end training.

    The column ``model`` has a row's model, or an array of its models; ``stop`` then has an array of flags, one for each of them.
    ``rows`` is read three times, so it should come from written tables. ``cuts`` of an earlier fit can be given again. ``path``: a
    folder that all executors share, for the rows' bins and predictions. Rows without a target don't count; a model without rows
    predicts NULL.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins must lie between 2 and 255")
    with _few_records(rows.sparkSession):
        return _fit(rows, features, target, settings, path, model, stop, bins, cuts)


@contextmanager
def _few_records(spark: SparkSession) -> Iterator[None]:
    """Readers and batches hold few of the (long) records while a fit's jobs run."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": str(RECORDS * 4)}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _summed(state: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A pass over stored records, ``RECORDS`` in a batch."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(k, RECORDS) for b in batches for k in range(0, b.num_rows, RECORDS))

    return state.mapInArrow(few, schema)


def _cached(state: DataFrame) -> RDD:
    """Stored records, to be read by many passes."""
    return state.rdd.map(lambda r: (r.set, bytes(r.y), None if r.f is None else bytes(r.f), bytes(r.bins))).persist(StorageLevel.MEMORY_AND_DISK)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _told(spark: SparkSession, known: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """Rows with what a table (a row a set of models: its models, its flags, and columns of ``schema``) tells of their set."""
    types = dict(known.dtypes)
    small = spark.createDataFrame(table, f"_own_models {types['_models']}, _own_stops {types['_stops']}, {schema}").coalesce(1)
    return known.join(F.broadcast(small), (F.col("_models") == F.col("_own_models")) & F.col("_stops").eqNullSafe(F.col("_own_stops")))


def _fit(rows: DataFrame, features: list[str], target: str, settings: dict[int, Settings], path: str, model: str, stop: str | None, bins: int, cuts: list[np.ndarray] | None) -> Boosted:
    spark = rows.sparkSession
    many = isinstance(rows.schema[model].dataType, ArrayType)
    models = F.col(model).cast("array<int>") if many else F.array(F.col(model).cast("int"))
    flags = F.col(stop) if many and stop else F.coalesce(F.lit(False) if stop is None else F.col(stop), F.lit(False))
    names = [f"_x{k}" for k in range(len(features))]
    known = rows.where(F.col(target).isNotNull()).select(
        models.alias("_models"), flags.alias("_stops"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)]
    )
    # a row a set of models; what is told of a set is found on the driver, not from each row's arrays
    kinds = [
        Row(raw=r._stops, models=r._models, stops=[bool(x) for x in r._stops] if isinstance(r._stops, list) else [bool(r._stops)] * len(r._models), n=r.n, s=r.s)
        for r in known.groupBy("_models", "_stops").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    ]
    kinds.sort(key=lambda r: (r.models, r.stops))
    total: dict[int, list[float]] = {}
    for r in kinds:
        for m, held in zip(r.models, r.stops, strict=True):
            if not held and m in settings:
                own = total.setdefault(m, [0.0, 0])
                own[0], own[1] = own[0] + r.s, own[1] + r.n
    base = {m: s / n for m, (s, n) in total.items()}
    absolute = [m for m in base if settings[m].loss == "l1"]
    if absolute:
        pairs = _told(spark, known, [(r.models, r.raw, m) for r in kinds for m, held in zip(r.models, r.stops, strict=True) if m in absolute and not held], "m int")
        for r in pairs.groupBy("m").agg(F.percentile_approx("y", 0.5, 10_000).alias("middle")).collect():  # a row a model
            base[r.m] = r.middle
    sets, slots, parts = {}, [], 0
    for k, r in enumerate(kinds):
        some = [(m, held) for m, held in zip(r.models, r.stops, strict=True) if m in base]
        sets[k] = _Set([m for m, _ in some], [h for _, h in some], [base[m] for m, _ in some])
    width, used = len(features), [k for k in sets if sets[k].models]
    rows_all = sum(kinds[k].n for k in used)
    share = max(LEAST_ROWS, min(PART_ROWS, -(-rows_all // (3 * spark.sparkContext.defaultParallelism))))
    before = 0
    for k in used:  # sets follow one another, so a part has few; a large one takes many parts
        slots.append((kinds[k].models, kinds[k].raw, k, before // share, max(1, -(-(before % share + kinds[k].n) // share))))
        before += kinds[k].n
    parts = max((a + n for *_, a, n in slots), default=1)
    if not cuts:
        times = [(r.models, r.raw, sum(not x for x in r.stops)) for r in kinds]
        cuts = sketched_cuts(_told(spark, known, times, "_times int"), names, bins, "_times")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.ascontiguousarray(binned(batch, names, cuts).T)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * width), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("part"), batch.column("y"), bytes_], ["set", "part", "y", "bins"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, y = batch.column("set").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
            out: dict[str, list] = {"set": [], "y": [], "f": [], "bins": []}
            cuts_ = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts_, cuts_[1:], strict=False):
                for k in range(a, b, PACK):
                    c = min(k + PACK, b)
                    for name, value in (("set", int(number[k])), ("y", y[k:c].tobytes()), ("f", None), ("bins", np.ascontiguousarray(codes[k:c].T).tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("set", pa.int32()), ("y", pa.binary()), ("f", pa.binary()), ("bins", pa.binary())]))

    dealt = _told(spark, known, slots, "set int, _from long, _parts long")
    dealt = dealt.select("set", (F.col("_from") + F.pmod(F.xxhash64("y", *names), F.col("_parts"))).cast("int").alias("part"), "y", *names)
    dealt = dealt.mapInArrow(coded, "set int, part int, y double, bins binary").repartitionById(parts, F.col("part")).sortWithinPartitions("set")
    # a task then holds few models, so that its partial sums are few, and a model of many rows is in many tasks
    dealt.select("set", "y", "bins").mapInArrow(packed, _STATE).write.parquet(f"{path}/state-0")
    state, written = spark.read.parquet(f"{path}/state-0"), 0
    held = _cached(state)
    out = Boosted(list(features), cuts, dict(settings), base, {m: [] for m in base}, {m: [] for m in base}, {m: 0.0 for m in base})
    place = {c: k for k, c in enumerate(features)}
    columns = {m: np.array(sorted(place[c] for c in (s.features or features)), dtype=np.int64) for m, s in settings.items()}
    fresh = {m: [] for m in base}  # trees that the stored predictions don't hold
    going = {m: _Growing(m, settings[m], columns[m], fresh[m]) for m in sorted(base)}
    while going:
        now = {m: p for m, p in going.items() if not p.done}
        tasks = max(1, min(spark.sparkContext.defaultParallelism, sum(len(p.live) for p in now.values()) // NODES))
        sums = held.mapPartitions(_summing({m: p.sent() for m, p in now.items()}, sets, width, bins + 1, tasks))
        for m, node, best in best_splits(sums, now, tasks).collect():
            if node == _ERROR:
                out.errors[m].append(best[0] / best[1])
            elif node == _SECONDS:
                out.seconds[m] += best[0]
            elif now[m].level < settings[m].depth:
                now[m].splits[node] = best
        for m, p in now.items():
            if p.level == 0:  # the error before this tree is known now
                s, errors, turn = settings[m], out.errors[m], len(out.trees[m])
                best = int(np.argmin(errors)) if errors else 0
                if turn >= s.iterations or not p.splits or (s.patience and errors and turn - best >= s.patience):
                    del going[m]
                    continue
            p.descend()
        by_rank = {m: p for m, p in going.items() if settings[m].loss == "l1"}
        if not all(p.done for p in by_rank.values()):  # these wait for one another, so that one job gives the values of all
            by_rank = {}
        grown = {m: p.grown() for m, p in going.items() if p.done and (settings[m].loss == "l2" or m in by_rank)}
        for m, (tree, sums_) in grown.items():
            if settings[m].loss == "l2":
                tree.value = np.array([settings[m].rate * g / (n + settings[m].l2) if n else 0.0 for g, n in sums_])
        if by_rank:
            for r in _leaf_medians(state, sets, {m: grown[m][0] for m in by_rank}, fresh, width).collect():  # a row a leaf
                grown[r.model][0].value[r.leaf] = settings[r.model].rate * r.middle
        for m, (tree, _) in grown.items():
            out.trees[m].append(tree)
            fresh[m].append(tree)
            going[m] = _Growing(m, settings[m], columns[m], fresh[m])
        if going and sum(len(fresh[m]) for m in going) >= KEEP * len(going):
            written += 1
            some = [k for k, x in sets.items() if set(x.models) & set(going)]
            _summed(state.where(F.col("set").isin(some)), _moved(sets, fresh, width), _STATE).write.parquet(f"{path}/state-{written}")
            held.unpersist()
            if written > 1:
                _delete(spark, f"{path}/state-{written - 1}")
            state, fresh = spark.read.parquet(f"{path}/state-{written}"), {m: [] for m in base}
            held = _cached(state)
            for m, p in going.items():
                p.trees = fresh[m]
    held.unpersist()
    for m, errors in out.errors.items():
        if errors and settings[m].patience:
            out.trees[m] = out.trees[m][: int(np.argmin(errors))]
    return out


def _moved(sets: dict[int, _Set], trees: dict[int, list[Tree]], width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for number, _, f, columns, sizes in _of_batch(batch, sets, width):
                now = np.stack([_plus(f[k], trees[m], columns) for k, m in enumerate(sets[number].models)])
                made += [np.ascontiguousarray(x).tobytes() for x in np.split(now, np.cumsum(sizes)[:-1], 1)]
            yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("y"), pa.array(made, pa.binary()), batch.column("bins")], ["set", "y", "f", "bins"])

    return run


def _leaf_medians(state: DataFrame, sets: dict[int, _Set], trees: dict[int, Tree], fresh: dict[int, list[Tree]], width: int) -> DataFrame:
    """(model, leaf, middle): medians of what is left to learn, by an approximate sketch with partial aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, y, f, columns, _ in _of_batch(batch, sets, width):
                for k, (m, stop) in enumerate(zip(sets[number].models, sets[number].stops, strict=True)):
                    if m in trees and not stop:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), m), pa.int32()), pa.array(trees[m].reached(columns).astype(np.int32)), pa.array(y - _plus(f[k], fresh[m], columns))], ["model", "leaf", "rest"])

    return _summed(state, run, "model int, leaf int, rest double").groupBy("model", "leaf").agg(F.percentile_approx("rest", 0.5, 10_000).alias("middle"))


def save_boosted(fitted: Boosted, spark: SparkSession, path: str) -> None:
    """Fitted models as a table of text, a row a model, to be read by ``load_boosted``."""
    whole = {"features": fitted.features, "cuts": [c.tolist() for c in fitted.cuts]}
    rows = []
    for m, trees in fitted.trees.items():
        own = {"settings": fitted.settings[m].__dict__, "base": fitted.base[m], "errors": fitted.errors.get(m, []), "seconds": fitted.seconds.get(m, 0.0)}
        own["trees"] = [{k: v.tolist() for k, v in t.__dict__.items()} for t in trees]
        rows.append((m, json.dumps(own)))
    spark.createDataFrame([(-1, json.dumps(whole)), *rows], "model int, body string").write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    rows = {r.model: json.loads(r.body) for r in spark.read.parquet(path).collect()}
    whole = rows.pop(-1)
    settings = {m: Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in r["settings"].items()}) for m, r in rows.items()}
    trees = {m: [Tree(**{k: np.array(v) for k, v in t.items()}) for t in r["trees"]] for m, r in rows.items()}
    cuts = [np.array(c, dtype=np.float64) for c in whole["cuts"]]
    return Boosted(whole["features"], cuts, settings, {m: r["base"] for m, r in rows.items()}, trees, {m: r["errors"] for m, r in rows.items()}, {m: r["seconds"] for m, r in rows.items()})

"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is described by counts of its own characters and words and by those of the
lines before and after it. A chain of two states, good and bad, is trained by gradient ascent on
lines that carry their document's label; forward-backward gives each line's marginal, and the
marginals, weighted by line length, make the document's score.

Training uses at most ``SAMPLE`` labelled documents (those with the smallest hashes of their id),
whole. Scoring is per row: no exchange, memory bounded by a batch of a few MB or one text.

Defined results: null, empty and blank texts are one empty line and are scored as such; where no
labelled row can be learnt from, or one label only, every score is 0.5 and nothing is rejected;
of rows that repeat a labelled id one is learnt from; equal texts get equal scores (rounded to nine
digits); very long texts are scored whole; an empty table gives no rows; other columns go along (one
named ``score`` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read, small_batches

SAMPLE = 3000
OWN = 12
SYMBOLS, PIPES, SHOUTS = b"#*$%&<>|~^=_\\{}", b"|", b"!?"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
OTHER = bytes(set(range(33, 127)) - set(UPPER + LOWER + DIGITS))


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN) features and the lengths of the lines that have a word; one empty line if none has."""
    rows, seen = [], set()
    for line in (text or b"").split(b"\n"):
        found = line.split()
        n, size = len(found), len(line)
        if not n:
            continue
        left = lambda chars, line=line: len(line.translate(None, chars))
        upper, lower = size - left(UPPER), size - left(LOWER)
        twins = sum(map(bytes.__eq__, found, found[1:]))
        rows.append((
            1.0, np.log1p(n) / 5, min(size / n / 10, 3.0), min((size - left(SYMBOLS)) / n, 1.0), min((size - left(PIPES)) / n, 1.0),
            min((size - left(SHOUTS)) / n, 1.0), upper / max(upper + lower, 1), (size - left(DIGITS)) / size, twins / n,
            1 - len(set(found)) / n, (size - left(OTHER)) / size, float(line in seen), size,
        ))
        seen.add(line)
    out = np.array(rows or [(1.0, *[0.0] * (OWN - 1), 1)])
    return out[:, :OWN], out[:, OWN]


def with_neighbours(own: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Adds, to the stacked lines of several texts, the features of the lines before and after within a text."""
    end = np.cumsum(sizes)
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[end - sizes], last[end - 1] = True, True
    before, after = np.roll(own[:, 3:], 1, axis=0), np.roll(own[:, 3:], -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None]])


FEATURES = OWN + 2 * (OWN - 3) + 2


def forward_backward(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of state 1 for the lines of many chains, each of the given size, and, if asked for, the expected transitions.

    ``emit``: (lines x 2) log potentials, stacked. Chains of like size are padded and run together.
    """
    marginal, expected = np.empty(len(emit)), np.zeros((2, 2))
    start = np.cumsum(sizes) - sizes
    step = np.exp(trans)
    potential = np.exp(emit - emit.max(axis=1, keepdims=True))
    group = np.ceil(np.log2(sizes)).astype(int)
    for g in np.unique(group):
        chains = np.flatnonzero(group == g)
        for some in np.array_split(chains, -(-len(chains) * (1 << int(g)) // 400_000)):
            n = sizes[some]
            at = start[some][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
            p = potential[at]  # chains x steps x 2
            live = np.arange(n.max()) < n[:, None]
            alpha, beta = np.empty_like(p), np.ones_like(p)
            a = p[:, 0]
            alpha[:, 0] = a = a / a.sum(axis=1, keepdims=True)
            for t in range(1, p.shape[1]):
                a = (a[:, :1] * step[0] + a[:, 1:] * step[1]) * p[:, t]
                alpha[:, t] = a = a / a.sum(axis=1, keepdims=True)
            for t in range(p.shape[1] - 2, -1, -1):
                x = p[:, t + 1] * beta[:, t + 1]
                b = x[:, :1] * step[:, 0] + x[:, 1:] * step[:, 1]
                beta[:, t] = np.where(live[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
            m = alpha * beta
            marginal[at[live]] = (m[..., 1] / m.sum(axis=2))[live]
            if pairs and p.shape[1] > 1:
                x = alpha[:, :-1, :, None] * step * (p * beta)[:, 1:, None, :]
                expected += (x / x.sum(axis=(2, 3), keepdims=True))[live[:, 1:]].sum(axis=0)
    return marginal, expected


def train(lines: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features for state 1, log transitions) by Adam on the penalised mean log likelihood of a line."""
    y = np.repeat(labels, sizes).astype(float)
    steps = np.maximum(sizes - 1, 0)
    seen = np.array([[steps[labels == 0].sum(), 0], [0, steps[labels == 1].sum()]], float)
    value, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for k in range(1, rounds + 1):
        trans = value[FEATURES:].reshape(2, 2)
        emit = np.stack([np.zeros(len(lines)), lines @ value[:FEATURES]], axis=1)
        marginal, expected = forward_backward(emit, sizes, trans, pairs=True)
        grad = np.concatenate([lines.T @ (y - marginal), (seen - expected).ravel()]) / len(lines) - decay * value
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        value = value + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return value[:FEATURES], value[FEATURES:].reshape(2, 2)


def score_texts(texts: list[bytes | None], model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    described = [line_features(t) for t in texts]
    sizes = np.array([len(own) for own, _ in described])
    lines = with_neighbours(np.vstack([own for own, _ in described]), sizes)
    emit = np.stack([np.zeros(len(lines)), (lines * model[0]).sum(axis=1)], axis=1)
    marginal, _ = forward_backward(emit, sizes, model[1])
    weight = np.concatenate([n for _, n in described])
    starts = np.cumsum(sizes) - sizes
    return np.round(np.add.reduceat(marginal * weight, starts) / np.add.reduceat(weight, starts), 9)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, "raw"):
            own = [line_features(t)[0].astype(np.float32).tobytes() for t in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array(own, pa.binary())], ["doc_id", "quality", "own"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Learns from labelled rows with crc32(doc_id) mod 3 other than 1; None if they don't hold both labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(chosen), "doc_id")
    described = texts.select("doc_id", "quality", "raw").mapInArrow(_describe, "doc_id long, quality int, own binary")
    rows = described.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("own").alias("own")).collect()  # one row an id
    if len({r.quality for r in rows}) < 2:
        return None
    rows = sorted((r.quality, bytes(r.own)) for r in rows)  # the order in which tasks end doesn't matter
    own = [np.frombuffer(x, np.float32).reshape(-1, OWN).astype(float) for _, x in rows]
    sizes = np.array([len(x) for x in own])
    return train(with_neighbours(np.vstack(own), sizes), sizes, np.array([q for q, _ in rows]))


def line_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds ``score`` (chance of label 1) to ``docs`` (doc_id, text, ...)."""
    docs = docs.drop("score", "_raw")
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "_raw"):
                scores = score_texts(batch.column("_raw").to_pylist(), model)
                yield batch.drop_columns(["_raw"]).append_column("score", pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"
    return docs.withColumn("_raw", F.col("text").cast("binary")).mapInArrow(run, schema)


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = line_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    held_out = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

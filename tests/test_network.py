"""The network: gradients against differences, learning, early stop, kept weights, odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import network as nw


def table(spark, n, seed, parts=3):
    r = random.Random(seed)
    rows = [(k, r.gauss(0, 1) if k % 9 else None, r.gauss(0, 1)) for k in range(n)]
    rows = [(k, x, y, abs(x or 0.0) * 40 + y * 10 + 500 if k % 11 else None) for k, x, y in rows]
    return spark.createDataFrame(rows, "id long, x double, y double, target double").repartition(parts, "id")


def test_gradient_equals_differences():
    sizes, rng = [3, 5, 4, 1], np.random.default_rng(0)
    weights, x, y = nw.start_weights(sizes, 1), rng.normal(size=(20, 3)), rng.normal(size=20)
    loss = lambda w: ((nw.forward(x, w, sizes)[-1][:, 0] - y) ** 2).mean() / 2 + 0.05 * (w**2).sum()
    found = nw.gradient(x, y, weights, sizes, 0.1)
    for k in range(0, len(weights), 3):
        step = np.zeros_like(weights)
        step[k] = 1e-6
        assert abs((loss(weights + step) - loss(weights - step)) / 2e-6 - found[k]) < 1e-5


def test_learns_what_a_line_cannot(spark):
    fit, val = table(spark, 3000, 1), table(spark, 400, 2)
    asked = []

    def draw(epoch):
        asked.append(epoch)
        return fit.withColumn("x", F.when((F.col("id") + epoch) % 10 != 0, F.col("x")))  # another tenth is missing each time

    net = nw.fit_network(draw, val, ["x", "y"], hidden=(16,), epochs=10, patience=10, rate=0.03)
    assert asked == [0, *range(10)]
    out = net.predict(val.withColumn("prediction", F.lit("old"))).where("target IS NOT NULL AND x IS NOT NULL").collect()
    mean = sum(r.target for r in out) / len(out)
    assert sum(abs(r.target - r.prediction) for r in out) < 0.3 * sum(abs(r.target - mean) for r in out)
    row = out[0]
    x = [(v - net.scale[c][0]) / net.scale[c][1] for c, v in (("x", row.x), ("y", row.y))]
    (a, b), (c, d) = nw.layers(net.weights, net.sizes)
    hidden = [max(0.0, sum(x[i] * a[i, j] for i in range(2)) + b[j]) for j in range(16)]
    plain = (sum(h * c[j, 0] for j, h in enumerate(hidden)) + d[0]) * net.scale["target"][1] + net.scale["target"][0]
    assert math.isclose(plain, row.prediction, rel_tol=1e-9)


def test_stops_and_keeps_the_best(spark, monkeypatch):
    fit, val = table(spark, 300, 1), table(spark, 60, 2)
    net = nw.fit_network(lambda epoch: fit, val, ["x", "y"], hidden=(4,), epochs=8, patience=2, rate=3.0)  # steps far too long
    assert len(net.errors) < 8
    again = net.predict(val).agg(F.avg(F.abs(F.col("target") - F.col("prediction")))).first()[0]
    assert math.isclose(again, net.errors[nw.smoothed_stop(net.errors, 2)], rel_tol=1e-8)


def test_odd_tables(spark):
    fit, val = table(spark, 50, 1), table(spark, 20, 2)
    blank = fit.withColumn("x", F.lit(None).cast("double")).withColumn("extra", F.lit(1))
    net = nw.fit_network(lambda epoch: blank, val.limit(0), ["x", "y"], hidden=(4,), epochs=2)
    assert net.predict(val).where("prediction IS NULL").count() == 0 and net.predict(val.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nw.fit_network(lambda epoch: fit.limit(0), val, ["x", "y"])


def test_weights_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(nw, "SHARD_ROWS", 100)
    fit, val = table(spark, 900, 4), table(spark, 100, 5)
    one = nw.fit_network(lambda epoch: fit.repartition(1), val, ["x", "y"], hidden=(6,), epochs=3, rate=0.01)
    four = nw.fit_network(lambda epoch: fit.repartition(4, "y"), val, ["x", "y"], hidden=(6,), epochs=3, rate=0.01)
    assert np.array_equal(one.weights, four.weights) and one.errors == four.errors

"""Gradient, training and stored form of the perceptron."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayflow.operators import perceptron as P
from stayflow.operators.metrics import positive_probability


def table(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(int)
    rows = [(f"c{i}", int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "CustomerID string, Churn int, x array<double>")
    return df.select("CustomerID", "Churn", array_to_vector("x").alias("features")), x, y


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    net = P.Net(hidden=(5, 4))
    layers = P.first_layers(3, net)
    x, y, w = rng.normal(0, 1, (20, 3)), rng.integers(0, 2, 20), rng.random(20)
    flat, got = P.packed(layers), P.gradient(x, y, w, layers)
    value = lambda f: P.loss(P.margins(x, P.unpacked(f, layers))[0], y, w)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert got[k] == pytest.approx((value(flat + step) - value(flat - step)) / 2e-6, abs=1e-5)


def test_one_step_is_adam_on_the_whole_batch(spark):
    df, x, y = table(spark, 90)
    net = P.Net(hidden=(4,), batches=1, epochs=2, validation=0.0, weights=(1.0, 3.0))
    got = P.packed(P.train(df.repartition(4), net).learned)
    layers = P.first_layers(3, net)
    flat, m, v = P.packed(layers), 0.0, 0.0
    weight = np.where(y == 1, 3.0, 1.0)
    for t in (1, 2):
        own = P.unpacked(flat, layers)
        g = (P.gradient(x, y, weight, own) + 1e-4 * P.packed([(a, 0 * b) for a, b in own])) / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    assert np.allclose(got, flat, atol=1e-9)


def test_it_learns_what_no_line_separates_and_stops_early(spark, tmp_path, monkeypatch):
    df, x, y = table(spark)
    passes = []
    sums = P.summed_counts
    monkeypatch.setattr(P, "summed_counts", lambda *a: passes.append(1) or sums(*a))
    net = P.Net(hidden=(16, 8), rate=0.02, batches=3, epochs=80, patience=4)
    model = P.train(df, net)
    assert len(passes) < 3 * 80
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    scored = PipelineModel.load(str(tmp_path / "m")).transform(df).select("Churn", "prediction", positive_probability().alias("p"))
    assert scored.where((F.col("prediction") == F.col("Churn"))).count() > 0.88 * len(y)
    p = 1 / (1 + np.exp(-P.margins(x, model.learned)[0]))
    assert np.allclose(sorted(r["p"] for r in scored.collect()), sorted(p))
    assert np.allclose(P.packed(P.train(df, net).learned), P.packed(model.learned), atol=1e-9)

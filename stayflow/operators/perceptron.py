"""Perceptron with ReLU layers, trained by Adam on mini-batches whose gradients executors add up.

Rows are dealt anew every epoch by a hash of (key, seed, epoch), so every row is in one batch of an epoch wherever it lies. A
pass sends the weights to the tasks and brings back one summed gradient; Adam's moments stay on the driver, whose state has
the size of the network. A hash-chosen share of the rows is kept for validation: training stops when its loss has not fallen by
TOLERANCE for `patience` epochs, and the weights of the best epoch are kept.

Sums are of floating-point numbers, so another layout of the rows may change last digits. Missing features count as zero.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.operators.boosting import ROWS_A_TASK, in_blocks, summed_counts, uniform

TOLERANCE = 1e-4
#: Partitions whose gradients the driver adds up itself; they are small.
DIRECT = 16
# Adam's decay rates and the term that keeps its step finite.
DECAY, SQUARED_DECAY, LEAST = 0.9, 0.999, 1e-8

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Net:
    """Settings. `batches` is their number in an epoch; `weights` are those of the two classes."""

    hidden: tuple[int, ...] = (128, 64, 32)
    rate: float = 0.003
    l2: float = 1e-4
    batches: int = 8
    epochs: int = 300
    patience: int = 15
    validation: float = 0.1
    weights: tuple[float, float] = (1.0, 1.0)
    seed: int = 42


def first_layers(width: int, net: Net) -> Layers:
    """Uniform starts within the square root of 6 (of 2 before the output) over a layer's inputs and outputs."""
    rng, sizes = np.random.default_rng(net.seed), [width, *net.hidden, 1]
    out = []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        bound = np.sqrt((2.0 if k == len(sizes) - 2 else 6.0) / (a + b))
        out.append((rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)))
    return out


def packed(layers: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def unpacked(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def margins(x: np.ndarray, layers: Layers) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log-odds of every row, and the input of every layer."""
    inputs = [x]
    for w, b in layers[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0.0))
    w, b = layers[-1]
    return (inputs[-1] @ w + b)[:, 0], inputs


def loss(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0.0, m) - y * m)).sum())


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, layers: Layers) -> np.ndarray:
    """Sum over rows of the gradient of the weighted log loss, flat."""
    m, inputs = margins(x, layers)
    back = (weight * (1.0 / (1.0 + np.exp(-m)) - y))[:, None]
    out: Layers = []
    for (w, _), given in zip(reversed(layers), reversed(inputs)):
        out.append((given.T @ back, back.sum(axis=0)))
        back = (back @ w.T) * (given > 0)
    return packed(out[::-1])


def _sums(layers: Layers, net: Net, width: int, epoch: int, batch: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Gradient, weight and rows of one mini-batch, and with the first one loss and weight of the validation rows."""
    flat = packed(layers)

    def of_batch(b: pa.RecordBatch) -> np.ndarray:
        x = np.frombuffer(b"".join(b.column("x").to_pylist()), float).reshape(-1, width)
        y, h = b.column("y").to_numpy(), b.column("h").to_numpy()
        own = unpacked(flat, layers)
        kept = uniform(h, net.seed, 0) < net.validation
        dealt = np.minimum((uniform(h, net.seed, epoch) * net.batches).astype(int), net.batches - 1)
        use = ~kept & (dealt == batch)
        weight = np.where(y == 1, net.weights[1], net.weights[0])
        tail = [weight[use].sum(), 0.0, 0.0]
        if batch == 0 and kept.any():
            tail[1:] = loss(margins(x[kept], own)[0], y[kept], weight[kept]), weight[kept].sum()
        return np.concatenate([gradient(x[use], y[use], weight[use], own), tail])

    return of_batch


def train(df: DataFrame, net: Net = Net(), label_col: str = "Churn", key_col: str = "CustomerID", features_col: str = "features") -> PerceptronModel:
    width = len(df.select(q(features_col)).first()[0])
    rows = df.select(F.xxhash64(q(key_col).cast("string")).alias("h"), q(label_col).cast("int").alias("y"), vector_to_array(q(features_col)).alias("v"))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.nan_to_num(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width), nan=0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r.tobytes() for r in x], pa.binary())], ["h", "y", "x"])

    first = rows.mapInArrow(as_bytes, "h long, y int, x binary").persist()
    n, cores = first.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // 50_000), min(-(-n // ROWS_A_TASK), cores))
    ready = in_blocks(first.repartition(parts, "h"))
    try:
        layers = first_layers(width, net)
        flat = packed(layers)
        moment, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
        best, best_flat, since = np.inf, flat, 0
        for epoch in range(1, net.epochs + 1):
            for batch in range(net.batches):
                work = _sums(unpacked(flat, layers), net, width, epoch, batch)
                total = summed_counts(ready, parts, work, flat.size + 3, float, DIRECT)
                own, (weight, lost, mass) = total[:-3], total[-3:]
                if batch == 0 and mass:
                    # the weights as they were after the last epoch
                    since = 0 if lost / mass < best - TOLERANCE else since + 1
                    if lost / mass < best:
                        best, best_flat = lost / mass, flat
                if weight:
                    decay = packed([(w, np.zeros_like(b)) for w, b in unpacked(flat, layers)])
                    own = (own + net.l2 * decay) / weight
                    step += 1
                    moment = DECAY * moment + (1 - DECAY) * own
                    square = SQUARED_DECAY * square + (1 - SQUARED_DECAY) * own * own
                    rate = net.rate * np.sqrt(1 - SQUARED_DECAY**step) / (1 - DECAY**step)
                    flat = flat - rate * moment / (np.sqrt(square) + LEAST)
                if since > net.patience:
                    break
            if since > net.patience:
                break
        chosen = best_flat if np.isfinite(best) else flat
    finally:
        ready.unpersist()
        first.unpersist()
    return PerceptronModel(layers=json.dumps([[w.tolist(), b.tolist()] for w, b in unpacked(chosen, layers)]))


class PerceptronModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `rawPrediction`, `probability` and `prediction`. The layers are a parameter, so they are stored with the stage."""

    layers = Param(Params._dummy(), "layers", "weights and offsets of every layer as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layers=None, featuresCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(featuresCol="features")

    @property
    def learned(self) -> Layers:
        return [(np.array(w), np.array(b)) for w, b in json.loads(self.getOrDefault(self.layers))]

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.learned)  # the size of the network

        @F.pandas_udf("double")
        def margin(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            return pd.Series(margins(np.nan_to_num(np.stack(features.to_numpy()).astype(float)), shared.value)[0])

        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
        out = df.withColumn("_margin", margin(vector_to_array(q(self.getOrDefault(self.featuresCol)))))
        out = out.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
        out = out.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
        return out.withColumn("prediction", (p >= 0.5).cast("double")).drop("_margin")

"""Principal components of centred rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.operators.distances import as_double_array


def covariance(df: DataFrame, col: str, mean: np.ndarray) -> tuple[np.ndarray, int]:
    """Sample covariance of an array column and the row count; each task returns one d x d sum, added up by Spark."""
    d = len(mean)

    def cross_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            if len(batch):
                gap = np.stack(batch["x"].to_numpy()) - mean
                total += gap.T @ gap
                n += len(gap)
        if n:
            yield pd.DataFrame({"slot": np.arange(d * d + 1), "value": np.append(total.ravel(), n)})

    sums = df.select(q(col).alias("x")).mapInPandas(cross_sums, "slot int, value double").groupBy("slot").agg(
        F.sum("value").alias("value")
    )
    flat = np.zeros(d * d + 1)
    for r in sums.collect():  # d x d + 1 numbers
        flat[r["slot"]] = r["value"]
    n = int(round(flat[-1]))
    return flat[:-1].reshape(d, d) / max(n - 1, 1), n


def pca_reduce(
    df: DataFrame, n_components: int = 2, features_col: str = "features"
) -> tuple[DataFrame, list[float]]:
    """Adds PC1..PCn of the centred rows and returns the explained variance ratios.

    Only the d x d covariance reaches the driver. The sign of a component is fixed by making its largest loading
    positive.
    """
    rows = as_double_array(df, features_col)
    mean = np.array(rows.agg(vector_to_array(Summarizer.mean(array_to_vector(q(features_col)))).alias("m")).first()["m"])
    cov, _ = covariance(rows, features_col, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(mean))] < 0, -1.0, 1.0)
    kept = [q(c) for c in df.columns if c != features_col]
    out = rows.select(*kept, q(features_col))
    for j in range(n_components):
        loading = F.array(*[F.struct(F.lit(float(v)).alias("w"), F.lit(float(m)).alias("m")) for v, m in zip(vectors[:, j], mean)])
        terms = F.zip_with(q(features_col), loading, lambda x, l: (x - l["m"]) * l["w"])
        out = out.withColumn(f"PC{j + 1}", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    total = values.sum()
    return out, [float(v / total) if total else 0.0 for v in values[:n_components]]

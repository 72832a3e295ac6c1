"""Sums over all rows that several fits share: one scan serves every fit that is still moving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.operators.distances import as_double_array


def vectors(df: DataFrame, features_col: str) -> DataFrame:
    """One array column `x`."""
    return as_double_array(df.select(q(features_col)), features_col).select(q(features_col).alias("x"))


def summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Runs `work(matrix of rows) -> flat vector` batch by batch; executors add the vectors up, the driver gets one."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
                part = work(flat.reshape(batch.num_rows, -1).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(np.asarray(total, float))], ["slot", "value"])

    parts = rows.mapInArrow(per_partition, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(parts))
    for r in parts:
        out[r["slot"]] = r["value"]
    return out


def squared_gaps(x: np.ndarray, centers: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """`norms`, the squares of the rows, serve several sets of centers."""
    norms = (x * x).sum(axis=1) if norms is None else norms
    return np.maximum(norms[:, None] - 2.0 * x @ centers.T + (centers * centers).sum(axis=1), 0.0)


def labelling_scores(rows: DataFrame, label: Callable[[np.ndarray], list[np.ndarray]], ks: list[int]) -> list[tuple[float, float | None]]:
    """(Davies-Bouldin index, mean silhouette under the squared metric) of several labellings, in two scans for all.

    `label` gives one label array per labelling. The squared distances of x to the n rows of a cluster add up to
    n |x|^2 - 2 x.sum + (sum of squared norms), so cluster sums are all that a row needs. One populated
    cluster has no silhouette.
    """
    d = len(rows.first()["x"])

    def sums(x: np.ndarray) -> np.ndarray:
        norms, out = (x * x).sum(axis=1), []
        for y, k in zip(label(x), ks):
            hot = np.eye(k)[y]
            out += [hot.sum(axis=0), (hot.T @ x).ravel(), hot.T @ norms]
        return np.concatenate(out)

    flat, at, stats = summed(rows, sums), 0, []
    for k in ks:
        n, total = flat[at:at + k], flat[at + k:at + k + k * d].reshape(k, d)
        stats.append((n, total, flat[at + k + k * d:at + 2 * k + k * d]))
        at += 2 * k + k * d

    def spread(x: np.ndarray) -> np.ndarray:
        norms, rows_, out = (x * x).sum(axis=1), np.arange(len(x)), []
        for y, k, (n, total, squares) in zip(label(x), ks, stats):
            means = total / np.maximum(n, 1)[:, None]
            gap = np.sqrt(((x - means[y]) ** 2).sum(axis=1))
            away = np.maximum(norms[:, None] * n - 2.0 * x @ total.T + squares, 0.0)
            inside = away[rows_, y] / np.maximum(n[y] - 1, 1)
            away = np.where(n > 0, away / np.maximum(n, 1), np.inf)
            away[rows_, y] = np.inf
            outside = away.min(axis=1)
            top = np.maximum(inside, outside)
            value = np.where((n[y] > 1) & (top > 0) & np.isfinite(outside), (outside - inside) / np.where(top > 0, top, 1.0), 0.0)
            out += [np.bincount(y, gap, k), [value.sum()]]
        return np.concatenate(out)

    flat, at, scores = summed(rows, spread), 0, []
    for k, (n, total, _) in zip(ks, stats):
        used = np.flatnonzero(n > 0)
        means, gap = total[used] / n[used, None], flat[at:at + k][used] / n[used]
        between = np.sqrt(squared_gaps(means, means))
        np.fill_diagonal(between, np.inf)
        ratio = np.divide(gap[:, None] + gap, between, out=np.zeros_like(between), where=between > 0)
        np.fill_diagonal(ratio, 0.0)
        index = float(ratio.max(axis=1).mean())
        scores.append((index, float(flat[at + k] / n.sum()) if len(used) > 1 else None))
        at += k + 1
    return scores

"""Gaussian mixtures with full, tied, diagonal and spherical covariances.

Expectation-maximisation with one scan per iteration for all fits of a search: tasks turn their rows into sums of r,
r.x and r.x.x' (numpy, Arrow batches), Spark adds them up, and k.d.d numbers a fit return to the driver. Parameters
travel inside the task closure, so no iteration compiles new code.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.functions.sizing import iteration_ready
from stayflow.operators.distances import as_double_array, silhouette_scores
from stayflow.operators.passes import labelling_scores, squared_gaps, summed, vectors
from stayflow.operators.segmentation import COVARIANCE_TYPES, kmeans_fits

RIDGE = 1e-6  # added to every variance
GMM_METRICS = "k int, covariance_type string, bic double, aic double, silhouette double, silhouette_metric string"


def free_parameters(k: int, d: int, covariance_type: str) -> int:
    spread = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[covariance_type]
    return k * d + (k - 1) + spread


def information_criteria(log_likelihood: float, n: int, k: int, d: int, covariance_type: str) -> tuple[float, float]:
    """(BIC, AIC)."""
    p = free_parameters(k, d, covariance_type)
    return -2 * log_likelihood + p * math.log(n), -2 * log_likelihood + 2 * p


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """log(weight) + log density per row and component; `covs` is one d x d matrix per component."""
    d = x.shape[1]
    out = np.empty((len(x), len(weights)))
    for j in range(len(weights)):
        chol = np.linalg.cholesky(covs[j])
        z = np.linalg.inv(chol) @ (x - means[j]).T
        out[:, j] = (
            np.log(weights[j]) - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
        )
    return out


def responsibilities(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = joint.max(axis=1, keepdims=True)
    scaled = np.exp(joint - top)
    total = scaled.sum(axis=1, keepdims=True)
    return scaled / total, (np.log(total) + top)[:, 0]


def _sums(x: np.ndarray, r: np.ndarray, log_lik: float) -> np.ndarray:
    """[log likelihood, r sums (k), r.x (k d), r.x.x' (k d d)] as one flat vector."""
    squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)  # one matrix product in place of a triple loop
    return np.concatenate([[log_lik], r.sum(axis=0), (r.T @ x).ravel(), (r.T @ squares).ravel()])


def _estimate(flat: np.ndarray, n: int, k: int, d: int, covariance_type: str):
    """New weights, means and covariances from the summed statistics."""
    nk = np.maximum(flat[1:1 + k], 10 * np.finfo(float).eps)
    means = flat[1 + k:1 + k + k * d].reshape(k, d) / nk[:, None]
    second = flat[1 + k + k * d:].reshape(k, d, d)
    eye = np.eye(d)
    each = second / nk[:, None, None] - np.einsum("ki,kj->kij", means, means)
    if covariance_type == "tied":
        shared = (nk[:, None, None] * each).sum(axis=0) / n
        covs = np.repeat((shared + RIDGE * eye)[None], k, axis=0)
    elif covariance_type == "full":
        covs = each + RIDGE * eye
    else:
        var = np.maximum(np.einsum("kii->ki", each), 0.0) + RIDGE
        if covariance_type == "spherical":
            var = np.repeat(var.mean(axis=1, keepdims=True), d, axis=1)
        covs = var[:, :, None] * eye
    return nk / n, means, covs


class GaussianMixtureEM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """EM for one covariance structure, started from a K-Means fit with the same seed."""

    k = Param(Params._dummy(), "k", "components", TypeConverters.toInt)
    covarianceType = Param(Params._dummy(), "covarianceType", "full, tied, diag or spherical", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "iterations at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "stop below this gain of mean log likelihood", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the start", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=2, covarianceType="diag", featuresCol="features", maxIter=100, tol=1e-3, seed=42):
        super().__init__()
        self._setDefault(k=2, covarianceType="diag", featuresCol="features", maxIter=100, tol=1e-3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "GaussianMixtureModelEM":
        task = (self.getOrDefault(self.covarianceType), self.getOrDefault(self.k), self.getOrDefault(self.seed))
        col = self.getOrDefault(self.featuresCol)
        with iteration_ready(vectors(df, col)) as rows:
            state = em_fits(rows, [task], self.getOrDefault(self.maxIter), self.getOrDefault(self.tol))[task]
        return GaussianMixtureModelEM(state=json.dumps(state), featuresCol=col)


Task = tuple[str, int, int]


def em_fits(rows: DataFrame, tasks: list[Task], max_iter: int = 100, tol: float = 1e-3) -> dict[Task, dict]:
    """Fitted state of each (covariance type, k, seed). `rows` has one array column `x`.

    The types of one (k, seed) share a K-Means start. One scan an iteration adds up the sums of all fits that still gain.
    """
    tasks = list(dict.fromkeys(tasks))
    starts = {t: c for t, (c, _) in kmeans_fits(rows, sorted({(k, seed) for _, k, seed in tasks})).items()}
    keys, d = list(starts), len(next(iter(starts.values()))[0])

    def hard(x: np.ndarray) -> np.ndarray:
        return np.concatenate([_sums(x, np.eye(len(starts[t]))[squared_gaps(x, starts[t]).argmin(axis=1)], 0.0) for t in keys])

    first = dict(zip(keys, _cut(summed(rows, hard), [k for k, _ in keys], d)))
    n = int(round(first[keys[0]][1:1 + keys[0][0]].sum()))
    params = {t: _estimate(first[t[1:]], n, t[1], d, t[0]) for t in tasks}
    mean_ll, used, live = dict.fromkeys(tasks, -np.inf), dict.fromkeys(tasks, 0), tasks
    for step in range(1, max_iter + 1):
        now = [params[t] for t in live]

        def soft(x: np.ndarray, now=now) -> np.ndarray:
            out = []
            for p in now:
                r, ll = responsibilities(log_joint(x, *p))
                out.append(_sums(x, r, ll.sum()))
            return np.concatenate(out)

        going = []
        for t, flat in zip(live, _cut(summed(rows, soft), [t[1] for t in live], d)):
            # the likelihood belongs to the parameters the scan ran with
            gain, mean_ll[t], used[t] = flat[0] / n - mean_ll[t], flat[0] / n, step
            if gain >= tol and step < max_iter:
                params[t] = _estimate(flat, n, t[1], d, t[0])
                going.append(t)
        live = going
        if not live:
            break
    return {
        t: {
            "covariance_type": t[0], "weights": params[t][0].tolist(), "means": params[t][1].tolist(), "covs": params[t][2].tolist(),
            "log_likelihood": float(mean_ll[t] * n), "n": n, "iterations": used[t],
        }
        for t in tasks
    }


def _cut(flat: np.ndarray, ks: list[int], d: int) -> list[np.ndarray]:
    """One flat vector of `_sums` per number of components."""
    ends = np.cumsum([1 + k + k * d + k * d * d for k in ks])
    return np.split(flat, ends[:-1])


class GaussianMixtureModelEM(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability` (array, sums to 1) and the hard label `Cluster_ID`."""

    state = Param(Params._dummy(), "state", "parameters as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None, featuresCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def learned(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def log_likelihood(self) -> float:
        return self.learned["log_likelihood"]

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.learned
        w, m, c = np.array(s["weights"]), np.array(s["means"]), np.array(s["covs"])

        @F.pandas_udf("array<double>")
        def posterior(x: pd.Series) -> pd.Series:
            r, _ = responsibilities(log_joint(np.stack(x.to_numpy()), w, m, c))
            return pd.Series(list(r))

        col = self.getOrDefault(self.featuresCol)
        values = as_double_array(df, col).select(*[q(n) for n in df.columns if n != col], q(col).alias("_x"))
        out = values.withColumn("probability", posterior("_x")).withColumnRenamed("_x", col)
        return out.withColumn(
            "Cluster_ID", (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
        )


def fit_gmm(
    df: DataFrame, k: int, covariance_type: str = "full", random_state: int = 42, restarts: int = 5,
    features_col: str = "features",
) -> tuple[GaussianMixtureModelEM, float]:
    """Best of several starts by log likelihood, with that likelihood; all starts share their scans."""
    with iteration_ready(vectors(df, features_col)) as rows:
        fits = em_fits(rows, [(covariance_type, k, random_state + i) for i in range(restarts)])
    best = max(fits.values(), key=lambda f: f["log_likelihood"])
    return GaussianMixtureModelEM(state=json.dumps(best), featuresCol=features_col), best["log_likelihood"]


def soft_labels(model: Model, df: DataFrame) -> DataFrame:
    """Hard label and `probability` as array<double>."""
    return as_double_array(model.transform(df), "probability")


def evaluate_gmm_grid(
    df: DataFrame,
    k_range: Iterable[int] = range(2, 11),
    covariance_types: Iterable[str] = COVARIANCE_TYPES,
    random_state: int = 42,
    restarts: int = 5,
    id_col: str = "Customer ID",
    features_col: str = "features",
    silhouette_metric: str = "squared",
) -> DataFrame:
    """BIC, AIC and silhouette of the hard labels per (k, covariance type); fits that collapse to one cluster are left out."""
    grid = [(c, k) for c in covariance_types for k in k_range]
    with iteration_ready(vectors(df, features_col)) as rows:
        fits = em_fits(rows, [(c, k, random_state + i) for c, k in grid for i in range(restarts)])
        best = [max((f for (c, k, _), f in fits.items() if (c, k) == g), key=lambda f: f["log_likelihood"]) for g in grid]
        params = [tuple(np.array(f[name]) for name in ("weights", "means", "covs")) for f in best]
        scores = [s for _, s in labelling_scores(rows, lambda x: [log_joint(x, *p).argmax(axis=1) for p in params], [k for _, k in grid])]
    d = len(best[0]["means"][0])
    if silhouette_metric != "squared":
        base = df.select(q(id_col), q(features_col))
        for i, f in enumerate(best):
            # each fit adds one label column to the same rows, so no join is needed to line the labels up
            model = GaussianMixtureModelEM(state=json.dumps(f), featuresCol=features_col)
            base = soft_labels(model, base).withColumnRenamed("Cluster_ID", f"g{i}").drop("probability")
        exact = silhouette_scores(base, [f"g{i}" for i in range(len(best))], id_col, features_col, silhouette_metric)
        scores = [exact[f"g{i}"] for i in range(len(best))]
    records = []
    for (kind, k), f, score in zip(grid, best, scores):
        if score is not None:
            bic, aic = information_criteria(f["log_likelihood"], f["n"], k, d, kind)
            records.append((k, kind, bic, aic, score, silhouette_metric))
    return df.sparkSession.createDataFrame(records, GMM_METRICS)

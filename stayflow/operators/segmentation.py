"""K-Means search, cluster profile and personas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow.functions.columns import half_even, nan_to_null, q, squared_distance
from stayflow.functions.rules import persona
from stayflow.functions.sizing import iteration_ready
from stayflow.operators.distances import silhouette_scores
from stayflow.operators.passes import labelling_scores, squared_gaps, summed, vectors

# Fixed order: ties between covariance types go to the earlier one.
COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")

KMEANS_METRICS = "k int, inertia double, silhouette double, davies_bouldin double, silhouette_metric string"


class CentroidModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the index of the nearest center, in column arithmetic; ties go to the lower index."""

    state = Param(Params._dummy(), "state", "centers and cost as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "label column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None, featuresCol="features", predictionCol="Cluster_ID"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="Cluster_ID")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def training_cost(self) -> float:
        return json.loads(self.getOrDefault(self.state))["cost"]

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in json.loads(self.getOrDefault(self.state))["centers"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getOrDefault(self.featuresCol)
        kind = df.schema[col].dataType
        x = q(col).cast("array<double>") if isinstance(kind, T.ArrayType) else vector_to_array(q(col))
        gaps = F.array(*[squared_distance(x, F.lit([float(v) for v in c])) for c in self.clusterCenters()])
        return df.withColumn(self.getOrDefault(self.predictionCol), (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def starting_centers(rows: DataFrame, tasks: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ over all rows for each (k, seed); one scan draws the next center of every task that still needs one.

    Every value of x that lies away from the chosen centers draws an exponential time by its hash, over its squared gap
    times its number of copies; the least one is the next center, which is a draw with those weights. Tasks of one seed
    share their draws. Copies of chosen points are drawn again only when no other point is left.
    """
    values = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.xxhash64("x").alias("h"))
    with iteration_ready(values) as counted:
        most = {s: max(k for k, other in tasks if other == s) for _, s in tasks}
        chosen: dict[int, list[np.ndarray]] = {s: [] for s in most}
        for step in range(max(most.values())):
            live = {s: np.array(chosen[s]) for s in most if step < most[s]}
            for s, x in _drawn(counted, live, step).items():
                chosen[s].append(x)
            for s in live:
                if len(chosen[s]) <= step:  # every point is a center already
                    chosen[s].append(chosen[s][step % len(set(map(tuple, chosen[s])))])
    return {(k, s): np.array(chosen[s][:k]) for k, s in tasks}


def _drawn(counted: DataFrame, chosen: dict[int, np.ndarray], step: int) -> dict[int, np.ndarray]:
    """seed -> one drawn x, from rows of (x, copies, h); seeds for which every x is chosen are left out."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, n, h = np.stack(batch["x"].to_numpy()).astype(float), batch["copies"].to_numpy(float), batch["h"].to_numpy().view(np.uint64)
            for s, centers in chosen.items():
                # differences rather than the expanded square: a chosen point is at exactly zero
                weight = n if not len(centers) else n * np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
                z = h ^ np.random.SeedSequence([abs(s), step]).generate_state(1, np.uint64)[0]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5
                time = np.where(weight > 0, -np.log(u / 2.0**53) / np.where(weight > 0, weight, 1.0), np.inf)
                at = int(time.argmin())
                if np.isfinite(time[at]) and (s not in best or time[at] < best[s][0]):
                    best[s] = (float(time[at]), x[at].tolist())
        if best:
            yield pd.DataFrame({"seed": list(best), "time": [b[0] for b in best.values()], "x": [b[1] for b in best.values()]})

    found = counted.mapInPandas(least, "seed long, time double, x array<double>")
    found = found.groupBy("seed").agg(F.min_by("x", F.struct("time", "x")).alias("x"))
    return {r["seed"]: np.array(r["x"]) for r in found.collect()}


def kmeans_fits(rows: DataFrame, tasks: list[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """(centers, cost) of each (k, seed). `rows` has one array column `x`; one scan an iteration serves all fits that still move."""
    centers = starting_centers(rows, tasks)
    d = len(next(iter(centers.values()))[0])
    middle = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)))
    middle = middle[:-1] / middle[-1]
    spread = summed(rows, lambda x: np.append(((x - middle) ** 2).sum(axis=0), len(x)))
    still = tol * (spread[:-1] / spread[-1]).mean()
    cost: dict[tuple[int, int], float] = {}
    live = list(dict.fromkeys(tasks))
    for step in range(max_iter + 1):
        now = [centers[t] for t in live]

        def work(x: np.ndarray, now=now) -> np.ndarray:
            norms, place, out = (x * x).sum(axis=1), np.arange(len(x)), []
            for c in now:
                gap = squared_gaps(x, c, norms)
                label = gap.argmin(axis=1)
                hot = np.eye(len(c))[label]
                out += [hot.sum(axis=0), (hot.T @ x).ravel(), [gap[place, label].sum()]]
            return np.concatenate(out)

        flat, at, moving = summed(rows, work), 0, []
        for t in live:
            k = t[0]
            n, total = flat[at:at + k], flat[at + k:at + k + k * d].reshape(k, d)
            cost[t] = float(flat[at + k + k * d])  # of the centers the scan ran with
            at += k + k * d + 1
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[t])
            if step < max_iter and ((moved - centers[t]) ** 2).sum() > still:
                centers[t] = moved
                moving.append(t)
        live = moving
        if not live:
            break
    return {t: (centers[t], cost[t]) for t in centers}


def _best(fits: dict[tuple[int, int], tuple[np.ndarray, float]], k: int, features_col: str) -> CentroidModel:
    centers, cost = min((f for (n, _), f in fits.items() if n == k), key=lambda f: f[1])
    return CentroidModel(state=json.dumps({"centers": centers.tolist(), "cost": cost}), featuresCol=features_col)


def fit_kmeans(
    df: DataFrame, k: int, random_state: int = 42, restarts: int = 10, features_col: str = "features"
) -> CentroidModel:
    """Best of several seeded restarts by training cost; all restarts share their scans."""
    with iteration_ready(vectors(df, features_col)) as rows:
        return _best(kmeans_fits(rows, [(k, random_state + i) for i in range(restarts)]), k, features_col)


def evaluate_k_range(
    df: DataFrame,
    k_range: Iterable[int] = range(2, 11),
    random_state: int = 42,
    restarts: int = 10,
    id_col: str = "Customer ID",
    features_col: str = "features",
    silhouette_metric: str = "squared",
) -> tuple[DataFrame, dict[int, CentroidModel]]:
    """Inertia, silhouette and Davies-Bouldin per k, with the fitted models so that none is fitted twice.

    All k and restarts share their scans, and two more scans score all k. `silhouette_metric` is `squared`
    (linear in the rows) or `euclidean` (quadratic); the metrics table names it.
    """
    ks = list(k_range)
    with iteration_ready(vectors(df, features_col)) as rows:
        fits = kmeans_fits(rows, [(k, random_state + i) for k in ks for i in range(restarts)])
        models = {k: _best(fits, k, features_col) for k in ks}
        centers = [np.array(models[k].clusterCenters()) for k in ks]
        scores = labelling_scores(rows, lambda x: [squared_gaps(x, c).argmin(axis=1) for c in centers], ks)
    silhouettes = {f"k{k}": s for k, (_, s) in zip(ks, scores)}
    if silhouette_metric != "squared":
        labelled = df.select(q(id_col), q(features_col))
        for k in ks:
            labelled = models[k].copy({models[k].predictionCol: f"k{k}"}).transform(labelled)
        silhouettes = silhouette_scores(labelled, [f"k{k}" for k in ks], id_col, features_col, silhouette_metric)
    records = [(k, models[k].training_cost, silhouettes[f"k{k}"], index, silhouette_metric) for k, (index, _) in zip(ks, scores)]
    return df.sparkSession.createDataFrame(records, KMEANS_METRICS), models


def select_best_k(metrics: DataFrame) -> DataFrame:
    """The row with the highest silhouette; ties go to the lowest k, undefined values are skipped."""
    return metrics.filter(nan_to_null(F.col("silhouette")).isNotNull()).orderBy(F.desc("silhouette"), "k").limit(1)


def select_best_gmm_config(metrics: DataFrame) -> DataFrame:
    """The row with the lowest BIC; ties go to the earlier covariance type, then to the lowest k."""
    place = F.array_position(F.array(*[F.lit(c) for c in COVARIANCE_TYPES]), F.col("covariance_type"))
    return metrics.filter(nan_to_null(F.col("bic")).isNotNull()).orderBy("bic", place, "k").limit(1)


def profile_clusters(df: DataFrame, label_col: str = "Cluster_ID") -> DataFrame:
    """Mean recency, frequency and monetary value, size and share per cluster, richest first."""
    per = df.groupBy(q(label_col).alias("Cluster_ID")).agg(
        F.avg("Recency").alias("Recency_mean"),
        F.avg("Frequency").alias("Frequency_mean"),
        F.avg("Monetary").alias("Monetary_mean"),
        F.count(F.lit(1)).alias("Customer_Count"),
    )
    # the window sees one row per cluster
    total = F.sum("Customer_Count").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("Pct_of_Base", half_even(F.col("Customer_Count") / total * 100, 2)).orderBy(
        F.desc("Monetary_mean"), "Cluster_ID"
    )


def assign_personas(profile: DataFrame) -> DataFrame:
    """Adds `Persona` to a cluster profile, relative to the medians over the clusters."""
    everything = Window.partitionBy(F.lit(0))  # one row per cluster
    mids = {c: F.median(f"{c}_mean").over(everything) for c in ("Recency", "Frequency", "Monetary")}
    return (
        profile.withColumns({f"_{c}": m for c, m in mids.items()})
        .withColumn(
            "Persona",
            persona(
                F.col("Recency_mean"), F.col("Frequency_mean"), F.col("Monetary_mean"),
                F.col("_Recency"), F.col("_Frequency"), F.col("_Monetary"),
            ),
        )
        .drop("_Recency", "_Frequency", "_Monetary")
    )


def persona_counts(personas: DataFrame) -> DataFrame:
    return personas.groupBy("Persona").agg(F.count(F.lit(1)).alias("n_clusters"))

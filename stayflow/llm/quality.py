"""Quality by hierarchical empirical Bayes.

A logistic model reads each whole text: byte frequencies, pairs of byte classes, the share of distinct words. It is
fitted on a bounded sample, at most about TRAIN_ROWS labelled rows picked by hashes of their ids; only feature vectors
of fixed length reach the driver. Its probabilities are the evidence of single documents.

Grouped aggregation then sums the evidence per host and per path of a host (combined before the shuffle, so a hot
host is one row a task). A host's posterior is its mean shrunk toward the global prior, a path's posterior its mean
shrunk toward its host's; how far, the spread of the group means tells (method of moments). Sparse sites thus
follow their parents, rich ones their own record. A document is judged by its own evidence with its path's
posterior, taken without the document itself, in place of the global prior.

Defined cases: a null text reads as empty; a null host or path is a group like any other; without usable labels every
document has probability 0.5 and is kept; rows may repeat; an empty table gives an empty result; input columns named
like results give way to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import attached, kept_whole, once, packed, unpacked

TRAIN_ROWS = 6000
STEPS, RATE, PENALTY = 400, 0.05, 1e-3
#: Bounds of the weight, in documents, that a parent has against its children.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0
KEEP_FROM = 0.5
CHUNK = 1 << 24


def _byte_classes() -> np.ndarray:
    classes = np.zeros(256, np.int64)
    for group, chars in enumerate((b" \t", b"\n\r", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b".,;:"), 1):
        classes[list(chars)] = group
    marks = [c for c in range(33, 127) if not classes[c]]
    for i, c in enumerate(marks):
        classes[c] = 8 + i % 8
    return classes


CLASS = _byte_classes()
WIDTH = 256 + 256 + 3


def features(text: str | None) -> np.ndarray:
    """Fixed-length vector of one whole text, read in chunks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    single, pairs, words, distinct = np.zeros(256), np.zeros(256), 0, set()
    for start in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - start), start)
        single += np.bincount(part, minlength=256)
        c = CLASS[part]
        pairs += np.bincount(c[:-1] * 16 + c[1:], minlength=256)
        found = data[start : start + CHUNK].split()
        words += len(found)
        distinct.update(map(hash, found))
    n = max(1, len(data))
    shape = [len(distinct) / max(1, words), np.log1p(words) / 10, n / max(1, words) / 20]
    return np.concatenate((np.sqrt(single / n), np.sqrt(pairs / n), shape))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Penalised logistic regression by full-batch gradient steps with per-weight rates."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    prior = float((y.sum() + 1) / (len(y) + 2))
    w, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        err = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
        g = np.append(z.T @ err / len(y) + PENALTY * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return Model(mean, scale, w, float(b), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on about `rows` labelled documents at most; None unless both classes are there."""
    known = labels.where(q(id_col).isNotNull() & q(label_col).isNotNull()).groupBy(q(id_col).alias("of_id")).agg(F.max(q(label_col).cast("double")).alias("y"))
    position = F.pmod(F.xxhash64(F.col("of_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = known.count()
    if not n:
        return None
    # about `rows` ids, whatever the labels hold
    chosen = kept_whole(known.where(position < min(1.0, rows / n)))
    found = docs.join(F.broadcast(chosen), q(id_col) == F.col("of_id")).select("y", q(text_col).cast("string").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype(np.float32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.binary())], ["y", "x"])

    drawn = sorted((r["y"], bytes(r["x"])) for r in found.mapInArrow(featured, "y double, x binary").collect())
    y = np.array([r[0] for r in drawn]) > 0.5
    if y.all() or not y.any():
        return None
    return fit(np.array([np.frombuffer(r[1], np.float32) for r in drawn], float), y.astype(float))


def evidence(rows: DataFrame, model: Model | None, text: Column) -> DataFrame:
    """Adds `p`, the probability of a good document by its text alone."""
    if model is None:
        return rows.withColumn("p", F.lit(0.5))
    held, key = rows.sparkSession.sparkContext.broadcast(astuple(model)), uuid.uuid4().hex

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        m = once(key, lambda: Model(*held.value))
        return pd.Series([float(m.probability(features(t))) for t in texts], dtype="float64")

    return rows.withColumn("p", probability(text.cast("string")))


def _prior_weight(groups: DataFrame, parent: Column) -> float:
    """Documents that a parent's mean is worth, from how far group means spread about their parents beyond chance."""
    of = F.col("sum_p") / F.col("n")
    row = groups.where(F.col("n") > 1).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (of - parent) * (of - parent)).alias("spread"),
        F.sum(F.col("sum_pp") - F.col("sum_p") * of).alias("inside"), F.count(F.lit(1)).alias("groups"),
    ).first()
    if not row["n"] or row["n"] <= row["groups"]:
        return MOST_PRIOR
    within = row["inside"] / (row["n"] - row["groups"])
    between = (row["spread"] - row["groups"] * within) / row["n"]
    return MOST_PRIOR if between <= 0 else float(min(MOST_PRIOR, max(LEAST_PRIOR, within / between)))


@dataclass
class Sites:
    """Evidence by path with its host's sums, and the two prior weights."""

    table: DataFrame
    mean: float
    host_weight: float
    path_weight: float


def sites(rows: DataFrame) -> Sites:
    """Grouped aggregation of rows (host, path, p)."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col("p") * F.col("p")).alias("sum_pp")]
    paths = kept_whole(rows.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_pp")])
    total = hosts.agg(F.sum("n"), F.sum("sum_p")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    host_weight = _prior_weight(hosts, F.lit(mean))
    of_host = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("sum_p").alias("host_p"))
    table = kept_whole(paths.join(of_host, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"))
    parent = (F.col("host_p") + F.lit(host_weight * mean)) / (F.col("host_n") + F.lit(host_weight))
    return Sites(table, mean, host_weight, _prior_weight(table, parent))


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def judged(rows: DataFrame, s: Sites, prior: float) -> DataFrame:
    """Adds host and path posteriors without the row itself, and the posterior of the row."""
    known = s.table.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "n", "sum_p", "host_n", "host_p")
    on = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    joined = attached(rows, known, on, F.col("p"))
    host = (F.col("host_p") - F.col("p") + s.host_weight * s.mean) / (F.col("host_n") - 1 + s.host_weight)
    path = (F.col("sum_p") - F.col("p") + s.path_weight * F.col("p_host")) / (F.col("n") - 1 + s.path_weight)
    shifted = _logit(F.col("p")) + _logit(F.col("p_path")) - F.lit(float(np.log(prior / (1 - prior))))
    return joined.withColumn("p_host", host).withColumn("p_path", path).withColumn("posterior", 1 / (1 + F.exp(-shifted)))


def quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """One row per document: evidence, host and path posteriors, its posterior, and whether it is kept."""
    model = train(docs, labels, id_col, text_col)
    rows = evidence(docs.select(q(id_col).alias("id"), host.alias("host"), path.alias("path"), q(text_col).alias("text")), model, F.col("text"))
    rows = kept_whole(rows.drop("text"))
    done = judged(rows, sites(rows), model.prior if model else 0.5)
    return done.select(F.col("id").alias(id_col), "host", "path", "p", "p_host", "p_path", "posterior", (F.col("posterior") >= keep_from).alias("keep"))


def quality_filter(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM
) -> DataFrame:
    """The documents that are kept, columns as they came. Texts stay where they are: two scans, no shuffle of rows."""
    model = train(docs, labels, id_col, text_col)
    rows = evidence(packed(docs, host=host, path=path), model, F.col("row").getField(text_col))
    s = sites(evidence(docs.select(host.alias("host"), path.alias("path"), q(text_col).alias("text")), model, F.col("text")))
    return unpacked(judged(rows, s, model.prior if model else 0.5).where(F.col("posterior") >= keep_from), docs)

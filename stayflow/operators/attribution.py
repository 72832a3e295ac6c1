"""Feature attribution for every customer: exact path-dependent tree Shapley values, or weighted z-scores.

Trees. A leaf contributes to a row through the features on its path only. With z_j the share of training cover
that follows the path at feature j and o_j = 1 if the row itself follows it, the Shapley value of feature i
(Lundberg et al. 2018) is

    v (o_i - z_i) * integral over t in [0, 1] of  prod_{j != i} (o_j t + z_j (1 - t)) dt

because the Shapley weight s!(m-1-s)!/m! is the Beta integral of t^s (1-t)^(m-1-s). The integrand is a polynomial
of degree m-1, so Gauss-Legendre nodes give it exactly.

What a leaf gives a row depends only on the bits o_j, so the values of all bit patterns are worked out once a tree and a row looks its
own up: leaves below one node share a table while the bits of its path and the sides taken below it are few (BITS). A row costs
one look-up for each feature of such a node, and no product. Trees with longer paths, few rows and rows with NaN are walked instead: the
products are carried down the tree and summed up it again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayflow.functions.columns import half_even, q
from stayflow.functions.rules import impact, risk_tier
from stayflow.operators.boosting import BoostedTreesModel
from stayflow.operators.distances import as_double_array
from stayflow.session import removed, shared_path

#: Numbers (nodes x quadrature nodes x rows) of one tree that are walked at a time; they should stay in a core's cache.
WALK_CELLS = 200_000
#: Bits of a table of values (its states are two to that power); rows that are looked up at a time.
BITS, LED = 11, 4096
#: Rows that a task gathers for one set of tables, and the least that are worth building them.
GATHERED, FEW = 1 << 16, 1500


# ---------------------------------------------------------------- tree values


def _stored_trees(model: Model) -> list[dict[int, tuple]]:
    """Nodes by id: (feature, cut, left, right, cover, value), the last two children None at a leaf; values are scaled.

    MLlib's nodes come from the saved model, whose size is fixed by trees and depth, not by the data.
    """
    if isinstance(model, BoostedTreesModel):
        learned = model.learned
        trees = [{0: (0, 0.0, None, None, 1.0, learned["base"])}]  # the base margin is a tree of one leaf
        for t in learned["trees"]:
            columns = zip(t["feature"], t["cut"], t["left"], t["right"], t["cover"], t["value"])
            trees.append({
                k: (f, cut, None, None, c, v) if left == k else (f, cut, left, right, c, v)
                for k, (f, cut, left, right, c, v) in enumerate(columns)
            })
        return trees
    spark = SparkSession.active()
    path = shared_path(spark, "trees")
    model.write().overwrite().save(path)
    try:
        rows = spark.read.parquet(f"{path}/data").collect()
    finally:
        removed(spark, path)
    boosted = isinstance(model, GBTClassificationModel)
    scale = list(model.treeWeights) if boosted else [1.0 / model.getNumTrees] * model.getNumTrees
    trees = [{} for _ in scale]
    for r in rows:
        node, stats = r["nodeData"], r["nodeData"]["impurityStats"]
        cover = stats[0] if boosted else sum(stats)
        value = (node["prediction"] if boosted else stats[1] / sum(stats)) * scale[r["treeID"]]
        if node["leftChild"] < 0:
            trees[r["treeID"]][node["id"]] = (0, 0.0, None, None, cover, value)
        else:
            split = node["split"]
            trees[r["treeID"]][node["id"]] = (
                split["featureIndex"], split["leftCategoriesOrThreshold"][0], node["leftChild"], node["rightChild"], cover, value,
            )
    return trees


def ensemble_leaves(model: Model) -> dict[int, dict[str, np.ndarray]]:
    """Leaves by number of path features: feature index, interval (lo, hi], cover share and value."""
    groups: dict[int, list[tuple]] = {}
    for nodes in _stored_trees(model):
        stack = [(0, {})]
        while stack:
            node_id, box = stack.pop()
            f, cut, left, right, cover, value = nodes[node_id]
            if left is None:
                groups.setdefault(len(box), []).append((value, box))
                continue
            for child, side in ((left, 0), (right, 1)):
                lo, hi, z = box.get(f, (-np.inf, np.inf, 1.0))
                z *= nodes[child][4] / cover
                part = (lo, min(hi, cut), z) if side == 0 else (max(lo, cut), hi, z)
                stack.append((child, {**box, f: part}))
    out = {}
    for m, leaves in groups.items():
        out[m] = {
            "value": np.array([v for v, _ in leaves]),
            "feature": np.array([list(b) for _, b in leaves], dtype=int).reshape(len(leaves), m),
            "lo": np.array([[p[0] for p in b.values()] for _, b in leaves]).reshape(len(leaves), m),
            "hi": np.array([[p[1] for p in b.values()] for _, b in leaves]).reshape(len(leaves), m),
            "share": np.array([[p[2] for p in b.values()] for _, b in leaves]).reshape(len(leaves), m),
        }
    return out


def base_value(leaves: dict[int, dict[str, np.ndarray]]) -> float:
    """Expected output: every leaf weighted by its cover share."""
    return float(sum((g["value"] * g["share"].prod(axis=1)).sum() for g in leaves.values()))


@dataclass
class Walk:
    """One tree for the walk: nodes level by level, the two children of a node side by side.

    Per node but the root: the path's interval (lo, hi] and cover share of its feature, and the node above it that tested the
    same feature. `when` and `unless` are the factors o t + z (1 - t) at the quadrature nodes for o = 1 and 0, `gain` and `loss` are
    weight x (o - z) / factor. `child` is the left one of a node's two children, 0 at a leaf; `cut` is the node's own.
    """

    feature: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    parent: np.ndarray
    above: np.ndarray
    value: np.ndarray
    levels: list[tuple[int, int]]
    when: np.ndarray
    unless: np.ndarray
    gain: np.ndarray
    loss: np.ndarray
    child: np.ndarray
    cut: np.ndarray


def ensemble_walks(model: Model) -> list[Walk]:
    """The trees in walking order; a tree of one leaf explains nothing and is left out."""
    shaped, most = [], 1
    for nodes in _stored_trees(model):
        if nodes[0][2] is None:
            continue
        rows, levels, level, splits = [(0, -np.inf, np.inf, 1.0, 0, -1, 0.0)], [(0, 1)], [(0, 0, {})], {}
        while level:
            below = []
            for node, place, path in level:
                f, cut, left, right, cover, _ = nodes[node]
                if left is None:
                    continue
                splits[place] = (len(rows), cut)
                lo, hi, z, above = path.get(f, (-np.inf, np.inf, 1.0, -1))
                for child, part in ((left, (lo, min(hi, cut))), (right, (max(lo, cut), hi))):
                    share = max(z * nodes[child][4] / cover, 1e-12)
                    at = len(rows)
                    rows.append((f, *part, share, place, above, nodes[child][5] if nodes[child][2] is None else 0.0))
                    below.append((child, at, {**path, f: (*part, share, at)}))
            if below:
                levels.append((below[0][1], len(rows)))
            most = max([most, *(len(path) for *_, path in below)])
            level = below
        shaped.append((rows, levels, splits))
    t, w = np.polynomial.legendre.leggauss((most + 1) // 2)
    t, w = (t + 1) / 2, w / 2
    out = []
    for rows, levels, splits in shaped:
        feature, lo, hi, z, parent, above, value = (np.array(c) for c in zip(*rows))
        when, unless = t + z[:, None] * (1 - t), z[:, None] * (1 - t)
        gain, loss = w * (1 - z)[:, None] / when, w * -z[:, None] / unless
        child, cut = (np.array([splits.get(k, (0, 0.0))[i] for k in range(len(rows))]) for i in (0, 1))
        out.append(Walk(feature, lo, hi, parent, above, value, levels, when, unless, gain, loss, child, cut))
    return out


@dataclass
class Table:
    """Values of the leaves below one node, features x states. A state's low bits tell, in the order in which the path first tests
    them, whether the row is within the path's interval of a feature; the next ones whether it goes left at each of `splits`."""

    features: list[int]
    splits: list[int]
    values: np.ndarray


def tree_tables(tree: Walk, bits: int = BITS) -> dict[int, Table] | None:
    """Tables by node, one on every path; None if a leaf has more path features than `bits`."""
    child = tree.child.tolist()
    inner = [0] * len(child)
    for node in range(len(child) - 1, -1, -1):  # children come after their node
        if child[node]:
            inner[node] = 1 + inner[child[node]] + inner[child[node] + 1]
    out, todo = {}, [(0, {})]
    while todo:
        node, path = todo.pop()
        if len(path) + inner[node] <= bits:
            out[node] = _table(tree, node, path)
        elif not child[node]:
            return None
        else:
            todo += [(k, {**path, int(tree.feature[k]): k}) for k in (child[node], child[node] + 1)]
    return out


def _table(tree: Walk, top: int, path: dict[int, int]) -> Table:
    """`path` has the lowest node above or at `top` that follows a test of each feature, in the order of the first tests."""
    features, splits, parts = list(path), [], []
    todo = [(top, path, ())]
    while todo:
        node, now, sides = todo.pop()
        if not tree.child[node]:
            parts.append((node, now, sides))
            continue
        splits.append(node)
        for k, left in ((tree.child[node], 1), (tree.child[node] + 1, 0)):
            f = int(tree.feature[k])
            features += [] if f in features else [f]
            todo.append((k, {**now, f: k}, (*sides, (f, len(path) + len(splits) - 1, left))))
    place, row = {f: i for i, f in enumerate(path)}, {f: i for i, f in enumerate(features)}
    state = np.arange(1 << (len(path) + len(splits)))
    values = np.zeros((len(features), len(state)))
    for leaf, now, sides in parts:
        within = {f: state >> i & 1 for f, i in place.items()}
        for f, bit, left in sides:
            side = state >> bit & 1 if left else 1 - (state >> bit & 1)
            within[f] = within[f] & side if f in within else side
        pattern = sum((within[f] << j for j, f in enumerate(now)), np.zeros_like(state))
        values[[row[f] for f in now]] += _leaf_values(tree, list(now.values()), tree.value[leaf]).take(pattern, axis=1)
    return Table(features, splits, values)


def _leaf_values(tree: Walk, nodes: list[int], value: float) -> np.ndarray:
    """What a leaf gives the features of its path for every pattern of bits, features x patterns."""
    product = np.full((1, tree.when.shape[1]), value)
    for k in nodes:
        product = np.concatenate((product * tree.unless[k], product * tree.when[k]))
    follows = np.arange(len(product)) >> np.arange(len(nodes))[:, None] & 1
    return np.where(follows, tree.gain[nodes] @ product.T, tree.loss[nodes] @ product.T)


def _looked_up(x: np.ndarray, tree: Walk, tables: dict[int, Table], phi: np.ndarray) -> None:
    """Adds the values of one tree; `x` and `phi` are features x rows."""
    todo = [(0, {}, np.zeros(x.shape[1], np.uint16))]
    held = np.empty(x.shape[1])
    while todo:
        node, places, state = todo.pop()
        if node in tables:
            table = tables[node]
            for i, k in enumerate(table.splits):
                left = x[tree.feature[tree.child[k]]] <= tree.cut[k]
                state = state | np.multiply(left, 1 << (len(places) + i), dtype=np.uint16)
            at = state.astype(np.intp)
            for f, values in zip(table.features, table.values):
                values.take(at, out=held, mode="clip")
                phi[f] += held
            continue
        first = int(tree.child[node])
        f = int(tree.feature[first])
        left = x[f] <= tree.cut[node]
        for k, side in ((first, left), (first + 1, ~left)):
            if f in places:
                todo.append((k, places, state & ~np.multiply(~side, 1 << places[f], dtype=np.uint16)))
            else:
                todo.append((k, {**places, f: len(places)}, state | np.multiply(side, 1 << len(places), dtype=np.uint16)))


def tree_values(x: np.ndarray, walks: list[Walk]) -> np.ndarray:
    """Shapley values, rows x features."""
    whole = ~np.isnan(x).any(axis=1)
    if whole.sum() < FEW:
        return walked_values(x, walks)
    if not whole.all():
        phi = np.zeros_like(x, dtype=float)
        phi[whole], phi[~whole] = tree_values(x[whole], walks), walked_values(x[~whole], walks)
        return phi
    turned, phi, deep = np.ascontiguousarray(x.T, dtype=float), np.zeros(x.shape[::-1]), []
    for tree in walks:
        tables = tree_tables(tree)
        if tables is None:
            deep.append(tree)
            continue
        for b in range(0, len(x), LED):
            part = np.zeros((x.shape[1], len(x[b:b + LED])))
            _looked_up(np.ascontiguousarray(turned[:, b:b + LED]), tree, tables, part)
            phi[:, b:b + LED] += part
    return phi.T + walked_values(x, deep)


def walked_values(x: np.ndarray, walks: list[Walk]) -> np.ndarray:
    """Shapley values, rows x features, in one walk down and one up each tree.

    Down, every node carries the product of its path's factors; up, it gathers product x value of its leaves. The leaves below an
    edge share the edge's own factor, so the edge's share for its feature is one sum over quadrature nodes; a feature tested
    again below takes its place, so what is below the second test is taken back from the first.
    """
    phi = np.zeros_like(x, dtype=float)
    for tree in walks:
        n, q_ = tree.when.shape
        place = np.zeros((n, x.shape[1]))
        place[np.arange(1, n), tree.feature[1:]] = 1.0
        again = np.flatnonzero(tree.above >= 0)
        above = tree.above[again]
        step = max(8, WALK_CELLS // (n * q_))
        for b in range(0, len(x), step):
            seen = x[b:b + step].T[tree.feature]
            follows = (seen > tree.lo[:, None]) & (seen <= tree.hi[:, None])
            factor = np.where(follows[:, None, :], tree.when[:, :, None], tree.unless[:, :, None])
            ratio = factor.copy()
            ratio[again] /= factor[above]
            ratio[0] = 1.0
            for lo, hi in tree.levels[1:]:
                ratio[lo:hi] *= ratio[tree.parent[lo:hi]]
            ratio *= tree.value[:, None, None]
            for lo, hi in tree.levels[:0:-1]:
                ratio[tree.parent[lo:hi:2]] += ratio[lo:hi:2] + ratio[lo + 1:hi:2]
            share = _share(ratio, tree, np.arange(n), follows)
            share[again] -= _share(ratio[again], tree, above, follows[above])
            phi[b:b + step] += share.T @ place
    return phi


def _share(gathered: np.ndarray, tree: Walk, nodes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    return np.where(follows, np.einsum("nqr,nq->nr", gathered, tree.gain[nodes]), np.einsum("nqr,nq->nr", gathered, tree.loss[nodes]))


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            yield held
            held = []
    if held:
        yield held


def tree_attributions(
    df: DataFrame, model: Model, features_col: str = "features", out_col: str = "attribution"
) -> DataFrame:
    """Adds an array of Shapley values, in feature order. A forest explains the probability, boosting the margin.

    Rows are dealt evenly to two tasks a core: tables are built once a task, so many small tasks would mostly build.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    shared = df.sparkSession.sparkContext.broadcast(ensemble_walks(model))  # bounded by the model, not by the rows
    rows = as_double_array(df, features_col).repartition(tasks)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _gathered(batches):
            values = tree_values(np.concatenate([np.stack(b[features_col].to_numpy()).astype(float) for b in held]), shared.value)
            for batch, part in zip(held, np.split(values, np.cumsum([len(b) for b in held])[:-1])):
                batch[out_col] = list(part)
                yield batch

    return rows.mapInPandas(explain, schema)


def explains_trees(model: Model) -> bool:
    return isinstance(model, (BoostedTreesModel, GBTClassificationModel, RandomForestClassificationModel))


# ---------------------------------------------------------------- z-score fallback


def feature_moments(df: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Mean and sample deviation per feature; zero or undefined deviations become 1."""
    row = df.agg(
        *[F.avg(q(n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_samp(q(n)).alias(f"s{i}") for i, n in enumerate(names)],
    ).first()
    return (
        [row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(names))],
        [row[f"s{i}"] or 1.0 for i in range(len(names))],
    )


def zscore_attributions(
    df: DataFrame, names: list[str], means: list[float], stds: list[float], importances: list[float] | None = None,
    out_col: str = "attribution",
) -> DataFrame:
    """Adds the deviation of each feature from training, times its importance (uniform when there is none)."""
    weights = importances or [1.0 / len(names)] * len(names)
    return df.withColumn(
        out_col, F.array(*[(q(n) - F.lit(m)) / F.lit(s) * F.lit(w) for n, m, s, w in zip(names, means, stds, weights)])
    )


# ---------------------------------------------------------------- reports


def global_feature_importance(df: DataFrame, names: list[str], top_n: int | None = 15, col: str = "attribution") -> DataFrame:
    """Mean absolute attribution per feature, largest first. Complementary columns tie up to rounding noise, then by name."""
    one = df.agg(*[F.avg(F.abs(F.col(col)[i])).alias(f"a{i}") for i in range(len(names))])
    table = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"a{i}").alias("mean_abs_shap")) for i, n in enumerate(names)
    ])))
    ordered = table.orderBy(F.round("mean_abs_shap", 12).desc(), "feature")
    return ordered if top_n is None else ordered.limit(top_n)


def _factors(names: list[str], attribution: Column, values: Column) -> Column:
    """What the choice of factors needs of every feature; the rest is worked out for the chosen ones."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(
        F.arrays_zip(labels.alias("n"), attribution.alias("a"), values.alias("v")),
        lambda e, i: F.struct(half_even(e["a"], 4).alias("key"), i.alias("place"), e.alias("of")),
    )


def _factor(e: Column) -> Column:
    return F.struct(
        e["of"]["n"].alias("feature"), e["key"].alias("shap_value"), half_even(e["of"]["v"], 4).alias("feature_value"),
        impact(e["of"]["a"]).alias("impact"),
    )


def explain_customers(
    df: DataFrame, names: list[str], top_k: int = 5, id_col: str = "CustomerID", probability_col: str = "p",
    attribution_col: str = "attribution", values_col: str = "features",
) -> DataFrame:
    """Explanation record per customer: top risk drivers and protective factors, split on the rounded value.

    Everything happens inside the row; nothing is exploded or shuffled.
    """
    rows = as_double_array(df, values_col).withColumn("_f", _factors(names, F.col(attribution_col), q(values_col)))

    def top(keep, sign: int) -> Column:
        ranked = F.array_sort(F.transform(
            F.filter("_f", keep), lambda e: F.struct((e["key"] * sign).alias("k"), e["place"].alias("p"), e.alias("f"))
        ))
        return F.transform(F.slice(ranked, 1, top_k), lambda e: _factor(e["f"]))

    return rows.select(
        q(id_col).cast("string").alias("customer_id"),
        half_even(q(probability_col), 4).alias("churn_probability"),
        risk_tier(q(probability_col)).alias("risk_tier"),
        top(lambda e: e["key"] > 0, -1).alias("top_risk_drivers"),
        top(lambda e: e["key"] < 0, 1).alias("top_protective_factors"),
    )

"""Values looked up in tables equal those of the walk; rows are dealt to a bounded number of tasks."""

import numpy as np
import pytest

from stayflow.operators import attribution as A
from stayflow.operators.boosting import BoostedTreesModel


def grown(rng, depth, width):
    """A random tree as `_stored_trees` gives it; features repeat along a path where `width` is small."""
    nodes = {}

    def grow(at, left, cover):
        if left == 0 or (left < depth - 1 and rng.random() < 0.1):
            nodes[at] = (0, 0.0, None, None, cover, float(rng.normal()))
            return
        share = rng.uniform(0.1, 0.9)
        nodes[at] = (int(rng.integers(width)), float(np.round(rng.normal(), 1)), 2 * at + 1, 2 * at + 2, cover, 0.0)
        grow(2 * at + 1, left - 1, cover * share)
        grow(2 * at + 2, left - 1, cover * (1 - share))

    grow(0, depth, 100.0)
    return nodes


@pytest.mark.parametrize("depth,width", [(1, 3), (4, 3), (7, 5), (8, 40), (13, 60)])
def test_tables_equal_the_walk(monkeypatch, depth, width):
    rng = np.random.default_rng(depth)
    trees = [grown(rng, depth, width) for _ in range(3)]
    monkeypatch.setattr(A, "_stored_trees", lambda model: trees)
    monkeypatch.setattr(A, "FEW", 1)
    monkeypatch.setattr(A, "LED", 100)
    walks = A.ensemble_walks(None)
    x = np.round(rng.normal(size=(150, width)), 1)  # values on cuts
    x[3, 0] = np.nan
    assert np.allclose(A.tree_values(x, walks), A.walked_values(x, walks), rtol=0, atol=1e-12)
    assert any(A.tree_tables(w) is None for w in walks) == (depth > A.BITS)


def test_many_small_partitions_become_few_tasks(spark):
    model = BoostedTreesModel(trees='{"base": 0.5, "width": 2, "trees": [{"feature": [1, 0, 0], "left": [1, 1, 2], "right": [2, 1, 2], '
                                    '"cut": [0.0, 0.0, 0.0], "value": [0.0, -1.0, 2.0], "cover": [4.0, 1.0, 3.0]}]}')
    df = spark.createDataFrame([(str(i), [1.0, float(i % 2)]) for i in range(100)], "CustomerID string, features array<double>").repartition(60)
    out = A.tree_attributions(df, model)
    assert out.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    rows = out.collect()
    assert len(rows) == 100 and all(np.allclose(r["attribution"], [0.0, 0.75 if r["features"][1] else -2.25]) for r in rows)

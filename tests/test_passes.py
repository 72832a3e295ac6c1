"""Sums that fits share: batches arrive as matrices, squares of the rows serve every set of centers."""

import numpy as np
from pyspark.sql import functions as F

from stayflow.operators.passes import squared_gaps, summed


def test_sums_over_partitions_some_of_them_empty(spark):
    rows = spark.range(10).repartition(4).select(F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"))
    assert summed(rows, lambda x: np.append(x.sum(axis=0), len(x))).tolist() == [45.0, 20.0, 10.0]
    assert summed(rows, lambda x: np.array([len(x)])).tolist() == [10.0]  # whole numbers too


def test_given_squares_change_nothing():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(50, 3)), rng.normal(size=(4, 3))
    assert (squared_gaps(x, c, (x * x).sum(axis=1)) == squared_gaps(x, c)).all()

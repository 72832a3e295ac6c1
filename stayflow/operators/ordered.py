"""Running totals and global row numbers without a single-task window.

A window without PARTITION BY moves everything into one task. Here the order key is cut into ranges at
approximate quantiles, totals per range give each range its offset (a table of at most `ranges` rows), and
the window runs inside the ranges only. The split points are literals, so a retried task computes the same
ranges.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 50_000
MAX_RANGES = 4096


def range_bucketed(df: DataFrame, order_col: str, rows: int | None = None, bucket_col: str = "_range") -> DataFrame:
    """Adds the index of the value range each row falls in. `order_col` must be numeric."""
    n = df.count() if rows is None else rows
    ranges = max(1, min(MAX_RANGES, -(-n // ROWS_PER_RANGE)))
    if ranges == 1:
        return df.withColumn(bucket_col, F.lit(0))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.approxQuantile(order_col, probs, 0.25 / ranges)))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_order_value", outputCol="_bucket_value", handleInvalid="keep")
    return (
        bucketizer.transform(df.withColumn("_order_value", F.col(order_col).cast("double")))
        .withColumn(bucket_col, F.col("_bucket_value").cast("int"))
        .drop("_order_value", "_bucket_value")
    )


def running_totals(
    df: DataFrame, order_col: str, totals: dict[str, str], descending: bool = False, rows: int | None = None
) -> DataFrame:
    """Adds inclusive running sums: `totals` maps a value column to the name of its running sum.

    `order_col` values should be distinct (group by them first); equal values get an arbitrary order.
    """
    bucketed = range_bucketed(df, order_col, rows)
    per_range = bucketed.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{out}") for v, out in totals.items()])
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    # per_range has at most MAX_RANGES rows, so its own window is small by construction
    before = Window.partitionBy(F.lit(0)).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in totals.values()]
    )
    row_order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = Window.partitionBy("_range").orderBy(row_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = bucketed.join(F.broadcast(offsets), "_range")
    for value, out in totals.items():
        joined = joined.withColumn(out, F.col(f"_o_{out}") + F.sum(value).over(inside))
    return joined.drop("_range", *[f"_o_{out}" for out in totals.values()])


def global_positions(df: DataFrame, order_col: str, out_col: str = "position", tie_cols: list[str] | None = None) -> DataFrame:
    """1-based position of every row in the order of a numeric column, ties by `tie_cols`."""
    bucketed = range_bucketed(df, order_col)
    counts = bucketed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(order_col, *(tie_cols or []))
    return (
        bucketed.join(F.broadcast(offsets), "_range")
        .withColumn(out_col, F.col("_offset") + F.row_number().over(inside))
        .drop("_range", "_offset")
    )

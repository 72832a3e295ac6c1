"""Exact stratified holdout and folds from hash order, without a global sort.

Rows of a class are ordered by an md5 of (id, seed). A histogram over hash prefixes (at most classes x 16^digits
rows, combined on the map side) tells where each prefix starts; only rows that share a prefix are ranked
together. The prefix length follows the row count, so a ranking group stays small at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.schemas import ID_COL, TARGET_COL, require_columns
from stayflow.sources.writers import write_splits

ROWS_PER_PREFIX = 20_000
MAX_DIGITS = 4


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def holdout_sizes(counts: dict[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class: the rounded-up total, shared out by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(total * test_size - 1e-9)
    exact = {c: n * wanted / total for c, n in counts.items()} if total else {}
    sizes = {c: math.floor(v) for c, v in exact.items()}
    rest = wanted - sum(sizes.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - sizes[c]), c))[:rest]:
        sizes[c] += 1
    return sizes


def class_counts(df: DataFrame, label_col: str = TARGET_COL) -> dict[int, int]:
    """Rows per class; the classes are few by definition of a label."""
    return {r[0]: r[1] for r in df.groupBy(q(label_col)).agg(F.count(F.lit(1))).collect()}


def _digits(n: int) -> int:
    return max(1, min(MAX_DIGITS, math.ceil(math.log(max(n, 1) / ROWS_PER_PREFIX, 16)))) if n > ROWS_PER_PREFIX else 1


def class_ranks(
    df: DataFrame, label_col: str = TARGET_COL, key_col: str = ID_COL, seed: int = 42, rows: int | None = None
) -> DataFrame:
    """Adds `_rank`, the 1-based position of a row inside its class in hash order."""
    n = sum(class_counts(df, label_col).values()) if rows is None else rows
    hashed = df.withColumn("_hash", order_hash(q(key_col), seed)).withColumn(
        "_prefix", F.substring("_hash", 1, _digits(n))
    )
    hist = hashed.groupBy(q(label_col).alias("_class"), "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.select("_class", "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # copies of one key tie on the hash; the row content then decides, so the order does not depend on partitions
    ties = F.xxhash64(*[q(c) for c in df.columns])
    inside = Window.partitionBy(q(label_col), "_prefix").orderBy("_hash", q(key_col), ties)
    joined = hashed.join(
        F.broadcast(starts.withColumnRenamed("_prefix", "_p")),
        (q(label_col) == F.col("_class")) & (F.col("_prefix") == F.col("_p")),
    )
    return joined.withColumn("_rank", F.col("_start") + F.row_number().over(inside)).drop(
        "_hash", "_prefix", "_p", "_class", "_start"
    )


def assign_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, label_col: str = TARGET_COL, key_col: str = ID_COL
) -> DataFrame:
    """Adds `split` (train or test) with exact class sizes."""
    require_columns(df, [label_col, key_col], "labelled rows")
    counts = class_counts(df, label_col)
    sizes = holdout_sizes(counts, test_size)
    limit = F.lit(0)
    for label, size in sizes.items():
        limit = F.when(q(label_col) == label, size).otherwise(limit)
    ranked = class_ranks(df, label_col, key_col, seed, sum(counts.values()))
    return ranked.withColumn("split", F.when(F.col("_rank") <= limit, "test").otherwise("train")).drop("_rank")


def split_churn_data(
    df: DataFrame,
    test_size: float = 0.2,
    random_state: int = 42,
    save_outputs: bool = False,
    output_dir: str | None = None,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test tables. `exact=False` samples per class, which is cheaper but only close in size."""
    require_columns(df, [TARGET_COL], "churn data")
    if exact:
        split = assign_split(df, test_size, random_state)
    else:
        draw = F.conv(F.substring(order_hash(q(ID_COL), random_state), 1, 13), 16, 10).cast("double") / float(16**13)
        split = df.withColumn("split", F.when(draw < test_size, "test").otherwise("train"))
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    if save_outputs:
        if output_dir is None:
            raise ValueError("output_dir is needed to save the splits")
        write_splits(train, test, output_dir)
    return train, test


def split_check(split: DataFrame, label_col: str = TARGET_COL) -> DataFrame:
    """Churn percentage and rows overall, in train and in test, from one grouping-sets aggregate."""
    return (
        split.rollup("split")
        .agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(q(label_col)) * 100).alias("churn_pct"))
        .withColumn("split", F.coalesce("split", F.lit("overall")))
    )


def assign_folds(
    df: DataFrame, folds: int = 5, seed: int = 42, label_col: str = TARGET_COL, key_col: str = ID_COL
) -> DataFrame:
    """Adds `fold` in 0..folds-1, dealt out per class so that fold sizes differ by at most one row per class."""
    return class_ranks(df, label_col, key_col, seed).withColumn(
        "fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")
    ).drop("_rank")

"""Connected components of an edge table by alternating star steps (Kiveris et al., 2014).

Every step is a grouped minimum, combined before the shuffle, and a join whose skewed partitions AQE can split. Edges never
reach the driver; each round is checkpointed, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.llm.common import kept_whole


#: Edges worth a task of their own where the caller asks for few tasks.
EDGES_A_TASK = 200_000


def _large_star(e: DataFrame, fewer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = fewer(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return fewer(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame, fewer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    least = fewer(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = fewer(e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, few_tasks: bool = False) -> DataFrame:
    """(u, v) pairs of longs -> (node, root) for every node that is not its own root; root is the least node reachable.

    With `few_tasks` a step uses a task for every EDGES_A_TASK counted edges: small graphs then leave few files a step.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = kept_whole(e)
    mark = _mark(e)
    while mark[0]:
        tasks = max(1, -(-mark[0] // EDGES_A_TASK))
        fewer = (lambda df, n=tasks: df.coalesce(n)) if few_tasks else (lambda df: df)
        e = kept_whole(fewer(_small_star(fewer(_large_star(fewer(e), fewer).distinct()), fewer).distinct()))
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(e: DataFrame) -> tuple:
    """Equal for equal edge sets, and in practice for no others: count and two sums of edge hashes."""
    h = F.xxhash64("u", "v")
    low, high = F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(h, 32))
    return tuple(e.agg(F.count(F.lit(1)), low, high).first())

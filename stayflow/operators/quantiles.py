"""Exact interpolated quantiles by grouped counts, one plan for every size.

Values of all columns are counted together, (column, value) pairs combined before the shuffle. Approximate cut points
split each column's distinct values into buckets; bucket totals (a bounded table) tell which bucket holds a
rank, and a running count inside those buckets finds the value. No task ever holds all values of a column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions.columns import nan_to_null, q

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 1024


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column; nulls and NaN are ignored, an empty column gives None."""
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), nan_to_null(q(c).cast("double")).alias("v")) for i, c in enumerate(cols)])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
        .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).persist()
    )
    try:
        sizes = {r["c"]: r for r in counts.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()}
        wanted = {i: sorted({r for p in probs for r in _ranks(p, sizes[i]["n"])}) for i in sizes}
        at = _values_at(counts, wanted, max((s["values"] for s in sizes.values()), default=0), rows_per_bucket)
    finally:
        counts.unpersist()
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = [_between(at[i], p, sizes[i]["n"]) if i in sizes else None for p in probs]
    return out


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def _ranks(p: float, n: int) -> tuple[int, int]:
    pos = p * (n - 1)
    return math.floor(pos), min(math.ceil(pos), n - 1)


def _between(at: dict[int, float], p: float, n: int) -> float:
    low, high = _ranks(p, n)
    if at[low] == at[high]:
        return at[low]
    return at[low] + (at[high] - at[low]) * (p * (n - 1) - low)


def _values_at(counts: DataFrame, wanted: dict[int, list[int]], values: int, rows_per_bucket: int) -> dict[int, dict[int, float]]:
    """Value at each wanted 0-based rank of each column."""
    buckets = max(1, min(MAX_BUCKETS, -(-values // rows_per_bucket)))
    placed = counts.withColumn("b", F.lit(0))
    if buckets > 1:
        steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = counts.groupBy("c").agg(F.array_distinct(F.percentile_approx("v", steps, 10 * buckets)).alias("cuts"))
        cuts = {r["c"]: r["cuts"] for r in cuts.collect()}  # at most MAX_BUCKETS numbers a column
        table = counts.sparkSession.createDataFrame(list(cuts.items()), "c int, cuts array<double>")
        placed = counts.join(F.broadcast(table), "c").withColumn("b", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
    totals: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("c", "b").agg(F.sum("n").alias("n")).orderBy("c", "b").collect():
        totals.setdefault(r["c"], []).append((r["b"], r["n"]))
    targets = []
    for c, ranks in wanted.items():
        before, todo = 0, list(ranks)
        for b, n in totals[c]:
            while todo and todo[0] < before + n:
                targets.append((c, b, todo[0], todo.pop(0) - before))
            before += n
    wanted_rows = counts.sparkSession.createDataFrame(targets, "c int, b int, rank long, inside long")
    order = Window.partitionBy("c", "b").orderBy("v")
    inside = placed.join(F.broadcast(wanted_rows.select("c", "b").distinct()), ["c", "b"], "left_semi").withColumn("upto", F.sum("n").over(order))
    found = inside.join(F.broadcast(wanted_rows), ["c", "b"]).where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    out: dict[int, dict[int, float]] = {c: {} for c in wanted}
    for r in found.select("c", "rank", "v").collect():  # one row a rank
        out[r["c"]][r["rank"]] = r["v"]
    return out

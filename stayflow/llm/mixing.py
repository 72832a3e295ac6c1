"""Mixing sources to target weights.

Words are summed per source (partial sums before the shuffle, so a hot source is one row a task). Weights share
a total of `share` times all words; a target stops at `cap` times its source, the excess going to the others by
weight. A source's rate is target / size; each document is emitted floor(rate) times, and once more when a hash
of seed, id and text falls below the fraction. Hashes, not random numbers, decide: a retried task and a second
run agree.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has
target and rate 0, so its documents are not emitted; rows equal in id and text share one decision; an empty
table gives an empty result; input columns named like results give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions.columns import hash_uniform, q
from stayflow.llm.common import attached, kept_whole, packed, unpacked, word_count

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SEED = "mix-1"


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> target and rate. One row a source, so its windows hold as many rows as there are sources.

    Sources in order of cap / weight fill up first. Walking that order, the level is what is left to share over
    the weight left; the first source that stays below its cap at that level fixes it for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    walk = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    t = (
        per_source.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(walk.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    )
    every_row = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every_row)
    t = t.withColumn("target", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.select("source", "source_size", "target", rate.alias("rate"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, keep_row: bool, **settings) -> DataFrame:
    size = word_count(q(text_col))
    per_source = docs.select(q(source_col).cast("string").alias("source"), size.alias("size")).groupBy("source").agg(
        F.sum("size").alias("source_size")
    )
    targets = kept_whole(source_targets(per_source, **settings))
    own = dict(
        id=q(id_col), source=q(source_col).cast("string"), size=size,
        u=hash_uniform(seed, q(id_col), F.md5(q(text_col))),
    )
    rows = packed(docs, **own) if keep_row else docs.select(*[c.alias(name) for name, c in own.items()])
    small = targets.withColumnRenamed("source", "of")
    joined = attached(rows, small, F.col("source").eqNullSafe(F.col("of")), F.col("u"))
    whole = F.floor("rate")
    copies = whole + (F.col("u") < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", copies)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **settings) -> DataFrame:
    """One row per document: size, its source's size and target, copies taken and words taken."""
    return _mixed(docs, id_col, text_col, source_col, seed, False, **settings).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **settings) -> DataFrame:
    """The mixture itself: every document as often as its rate says, columns as they came."""
    chosen = _mixed(docs, id_col, text_col, source_col, seed, True, **settings).where(F.col("copies") > 0)
    # one text can be long; repeating the row is a narrow step
    return unpacked(chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)

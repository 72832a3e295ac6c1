"""Partition counts that follow the data."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q

ROWS_PER_FIT_PARTITION = 50_000
#: Fewest rows worth a task of their own in scans that many fits share.
ROWS_PER_SHARED_TASK = 4_000


@contextmanager
def iteration_ready(df: DataFrame, key: str | None = None) -> Iterator[DataFrame]:
    """A persisted table for the many short jobs of a fit, released at the end.

    Given a unique key, rows are dealt by its hash, so that fits that sample by partition (MLlib's trees) see the same
    rows together in whatever files they come; what still depends on the partition count, one per
    ROWS_PER_FIT_PARTITION rows, is how each partition is sampled. Without a key, for sums that many fits share, rows are dealt evenly.
    """
    first = df.persist()
    n = first.count()
    parts = max(1, -(-n // ROWS_PER_FIT_PARTITION))
    if key is None:
        # heavy work a row: small tables use all cores
        parts = max(parts, min(-(-n // ROWS_PER_SHARED_TASK), df.sparkSession.sparkContext.defaultParallelism))
    kept = (first.repartition(parts) if key is None else first.repartition(parts, F.xxhash64(q(key)))).persist()
    try:
        kept.count()
        first.unpersist()
        yield kept
    finally:
        first.unpersist()
        kept.unpersist()

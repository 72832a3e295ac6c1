"""Helpers shared by the corpus operators: reading, packing rows, and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as struct `row`, and the named expressions beside it.

    Whatever the input calls its columns, they cannot clash with the operator's own.
    """
    return docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The columns of `docs` again, then the named ones; an input column of a result's name gives way to the result."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in columns]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of the text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def kept_whole(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir: read back after a lost executor, not computed again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salt_of(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def over_salts(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each salt, for the small side of a join whose large side has hot keys."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


_BUILT: dict[str, Any] = {}


def once(key: str, build: Callable[[], Any]) -> Any:
    """What `build` makes, kept by a Python worker from task to task; a new key replaces the old one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def text_chunks(text: str, size: int = 1 << 22) -> Iterator[str]:
    """A long text in parts that end before white space, so that no word is cut and memory is bounded."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


#: Rows of a side table (each under 200 bytes) up to which it is broadcast.
BROADCAST_ROWS = 50_000
SALTS = 32


def attached(rows: DataFrame, table: DataFrame, on: Column, spread: Column) -> DataFrame:
    """Inner join with a table of one row a key: a broadcast while its counted rows stay below the bound, else a shuffle
    in which rows of a hot key spread over salts by `spread`."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("row_salt", salt_of(SALTS, spread))
    return salted.join(over_salts(table, SALTS), on & (F.col("row_salt") == F.col("salt"))).drop("row_salt", "salt")

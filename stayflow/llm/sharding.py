"""Sharding over fixed virtual slots.

A record hashes into one of `slots` virtual slots (a pure function of id, size and checksum, so it never moves).
Bytes are summed per slot, and a stored, versioned table says which shard holds which slot. Rebalancing edits
that table by moving or swapping whole slots and stores it as the next version; records are never rehashed.

Only the slot table (at most `slots` rows, thousands) reaches the driver. Texts are read, never shuffled.

Defined cases: a null text has no bytes and checksum 0; a null id hashes like any other value; repeated rows
share a slot, and each takes its own place; an empty table gives an empty result and an even map; an input
column with the name of a result column gives way to it.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import packed, unpacked
from stayflow.session import shared_path

SLOTS = 4096
#: Rebalancing stops when the largest and the smallest shard differ by less than this part of the mean.
TOLERANCE = 0.001
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, row_count long, first_place long"


@dataclass
class SlotMap:
    """One version of the slot table; `path` is the folder that holds all versions."""

    path: str
    version: int
    shards: list[int]
    bytes: list[int]
    rows: list[int]

    def store(self, spark: SparkSession) -> SlotMap:
        """Appends this version. `first_place` is the number of rows in lower slots of the same shard."""
        seen: dict[int, int] = {}
        table = []
        for slot, (shard, size, n) in enumerate(zip(self.shards, self.bytes, self.rows, strict=True)):
            table.append((self.version, slot, shard, size, n, seen.get(shard, 0)))
            seen[shard] = seen.get(shard, 0) + n
        spark.createDataFrame(table, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(self.path)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MAP_SCHEMA).parquet(self.path).where(F.col("version") == self.version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()  # one row a slot
    return SlotMap(path, version, [r["shard"] for r in rows], [r["bytes"] for r in rows], [r["row_count"] for r in rows])


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Adds size, checksum and virtual slot to the packed rows; no shuffle."""
    text = F.coalesce(q(text_col), F.lit(""))
    sized = packed(docs, id=q(id_col), size=(F.octet_length(text) + 1).cast("long"), crc=F.crc32(text.cast("binary")))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col("id").cast("string"), "size", "crc"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: at most `slots` rows come to the driver."""
    size, n = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], n[r["virtual_slot"]] = r["bytes"], r["n"]
    return size, n


def rebalanced(shards: list[int], size: list[int], count: int, tolerance: float = TOLERANCE) -> list[int]:
    """Edits a slot-to-shard list so that the `count` shards hold nearly equal bytes.

    Slots of shards that no longer exist go to the lightest shard. Then the heaviest shard gives the lightest
    the slot nearest to half their difference, or swaps two slots where no single one helps. Every edit lowers
    the sum of squares, so this ends; slots that need not move stay.
    """
    shards = list(shards)
    held: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    load = [0] * count
    homeless = []
    for slot, shard in enumerate(shards):
        if 0 <= shard < count:
            held[shard].append((size[slot], slot))
            load[shard] += size[slot]
        else:
            homeless.append((size[slot], slot))
    for bytes_, slot in sorted(homeless, reverse=True):
        to = min(range(count), key=lambda s: (load[s], s))
        held[to].append((bytes_, slot))
        load[to] += bytes_
        shards[slot] = to
    for h in held:
        h.sort()
    enough = tolerance * sum(load) / count

    def nearest(options: list[tuple[int, int]], wanted: float, below: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(options, (wanted, -1))
        fits = [o for o in options[max(0, at - 1) : at + 1] if 0 < o[0] < below]
        return min(fits, key=lambda o: (abs(o[0] - wanted), o[1])) if fits else None

    def move(entry: tuple[int, int], source: int, to: int) -> None:
        held[source].remove(entry)
        bisect.insort(held[to], entry)
        load[source] -= entry[0]
        load[to] += entry[0]
        shards[entry[1]] = to

    while True:
        hi, lo = max(range(count), key=lambda s: (load[s], -s)), min(range(count), key=lambda s: (load[s], s))
        gap = load[hi] - load[lo]
        if gap <= enough:
            return shards
        if one := nearest(held[hi], gap / 2, gap):
            move(one, hi, lo)
            continue
        best = None
        for back in held[lo]:
            there = nearest(held[hi], back[0] + gap / 2, back[0] + gap)
            if there and there[0] > back[0] and (best is None or abs(there[0] - back[0] - gap / 2) < best[0]):
                best = (abs(there[0] - back[0] - gap / 2), there, back)
        if best is None:
            return shards
        move(best[1], hi, lo)
        move(best[2], lo, hi)


def balanced_map(rows: DataFrame, count: int, slots: int = SLOTS, path: str | None = None) -> SlotMap:
    """Version 1 deals slots round robin; version 2 is version 1 edited by the bytes of the rows. Both are stored."""
    spark = rows.sparkSession
    size, n = slot_totals(rows, slots)
    first = SlotMap(path or shared_path(spark, "slot-map"), 1, [s % count for s in range(slots)], size, n).store(spark)
    return SlotMap(first.path, 2, rebalanced(first.shards, size, count), size, n).store(spark)


def grown(slot_map: SlotMap, spark: SparkSession, count: int) -> SlotMap:
    """The next version for another number of shards, by the bytes the map already holds."""
    return SlotMap(
        slot_map.path, slot_map.version + 1, rebalanced(slot_map.shards, slot_map.bytes, count), slot_map.bytes, slot_map.rows
    ).store(spark)


def with_shards(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard and first_place. The broadcast side has one row a slot, whatever the data."""
    table = slot_map.table(rows.sparkSession).select("virtual_slot", "shard", "first_place")
    return rows.join(F.broadcast(table), "virtual_slot")


def shard_documents(docs: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """The input's columns with `shard`, `virtual_slot` and `map_version`; rows stay where they are."""
    rows = placed(docs, id_col, text_col, slots)
    slot_map = balanced_map(rows, count, slots)
    return unpacked(
        with_shards(rows, slot_map), docs,
        shard=F.col("shard"), virtual_slot=F.col("virtual_slot"), map_version=F.lit(slot_map.version),
    )


def shard_places(docs: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per document with its shard and its gapless place there, from 0.

    A place is the rows in lower slots of the shard (known from the slot table) plus the place in the slot.
    Equal records are counted before the shuffle and dealt out again after it, so copies of one record cannot
    fill a task; the window runs inside slots, which are many and even.
    """
    rows = placed(docs, id_col, text_col, slots)
    slot_map = balanced_map(rows, count, slots)
    counted = rows.groupBy("virtual_slot", "id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("virtual_slot").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    starts = with_shards(counted, slot_map).withColumn(
        "start", F.col("first_place") + F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    return starts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("start") + F.col("k")).alias("slot"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )

"""Benchmark decontamination.

Benchmark texts become a hash set of word windows, broadcast to the scan of the documents. A document's words
are first looked up in the vocabulary of the windows; only stretches of known words can be windows, and those are
verified word by word. Hit documents are dropped, or their hit spans cut out.

Benchmarks are taken in blocks of bounded size, one broadcast each, so a large benchmark means more passes over
the documents and never a larger broadcast.

Defined cases: a null text has no words; an item with fewer words than a window is one window, an item without
words none; a null item id still marks words but is not listed; repeated items count once; with an empty
benchmark nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole, once, packed, unpacked
from stayflow.llm.simhash import LOWER

WINDOW = 10
#: Bytes of benchmark text in one block; its windows take about fifty times as much in a worker.
BLOCK_BYTES = 1 << 20
#: Bytes of a document whose words are held at a time.
CHUNK = 1 << 22
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

Item = tuple[str | None, str]


def words_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER)


class Windows:
    """The hash set of one block: window -> items, by length, and the vocabulary."""

    def __init__(self, items: list[Item]):
        self.items: dict[bytes, set[str]] = {}
        lengths = set()
        vocabulary: set[bytes] = set()
        for item, text in items:
            words = WORD.findall(words_of(text))
            size = min(WINDOW, len(words))
            if not size:
                continue
            lengths.add(size)
            vocabulary.update(words)
            for i in range(len(words) - size + 1):
                owners = self.items.setdefault(b" ".join(words[i : i + size]), set())
                if item is not None:
                    owners.add(item)
        self.lengths, self.vocabulary = sorted(lengths), vocabulary

    def scan(self, text: str) -> tuple[int, list[int], set[str]]:
        """Words of the text, the positions of those that are hit, and the items found."""
        data = words_of(text)
        total, hit, found, tail = 0, set(), set(), []
        start = 0
        while start < len(data):
            end = start + CHUNK
            while end < len(data) and WORD.match(data, end):
                end += 1
            new = WORD.findall(data, start, end)
            start = end
            words, base = tail + new, total - len(tail)
            total += len(new)
            known = np.fromiter(map(self.vocabulary.__contains__, words), np.int32, len(words))
            sums = np.concatenate(([0], np.cumsum(known)))
            for size in self.lengths:
                if len(words) < size:
                    break
                for i in np.flatnonzero(sums[size:] - sums[:-size] == size).tolist():
                    owners = self.items.get(b" ".join(words[i : i + size]))
                    if owners is not None:
                        hit.update(range(base + i, base + i + size))
                        found |= owners
            tail = words[-(WINDOW - 1) :]
        return total, sorted(hit), found


def spans_of(text: str, hit: list[int]) -> list[list[int]]:
    """Byte offsets [start, end) of the runs of hit words in the UTF-8 text."""
    spans: list[list[int]] = []
    if hit:
        marked, last = set(hit), -2
        for i, m in enumerate(WORD.finditer(words_of(text))):
            if i in marked:
                if last == i - 1:
                    spans[-1][1] = m.end()
                else:
                    spans.append([m.start(), m.end()])
                last = i
    return spans


FOUND = [
    StructField("n_words", LongType()), StructField("hits", ArrayType(LongType())), StructField("items", ArrayType(StringType())),
]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Item]]:
    """The distinct benchmark rows in blocks of about BLOCK_BYTES, one on the driver at a time."""
    rows = benchmark.select(q(item_col).cast("string").alias("item"), q(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in block.collect()]


def _scanned(rows: DataFrame, items: list[Item]) -> DataFrame:
    held, key = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    out = StructType([rows.schema["id"], rows.schema["digest"], *FOUND])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = once(key, lambda: Windows(held.value))
        for b in batches:
            seen = [windows.scan(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("digest"), pa.array([s[0] for s in seen], pa.int64()),
                    pa.array([s[1] for s in seen], pa.list_(pa.int64())), pa.array([sorted(s[2]) for s in seen], pa.list_(pa.string())),
                ],
                ["id", "digest", "n_words", "hits", "items"],
            )

    return rows.mapInArrow(of_batches, out)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, digest, n_words, hits, items) of every document: word positions inside windows, items sorted as strings."""
    rows = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("digest"), q(text_col).cast("string").alias("text"))
    passes = [_scanned(rows, items) for items in blocks(benchmark, item_col, item_text)]
    if len(passes) == 1:
        return passes[0]
    every = passes[0].select("id", "digest", "n_words")
    hit = passes[0]
    for more in passes[1:]:
        hit = hit.unionByName(more)
    # rows equal in id and text have equal hits, so they share one merged row
    merged = hit.where(F.size("hits") > 0).groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    joined = every.join(merged, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    return joined.select(
        "id", "digest", "n_words", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row per document with counts in place of positions."""
    found = contamination(docs, benchmark, id_col, **columns)
    return found.select(
        F.col("id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "document", **columns
) -> DataFrame:
    """The documents without hits (`document`), or all of them with the hit spans cut out (`span`)."""
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    found = contamination(docs, benchmark, id_col, text_col, **columns).where(F.size("hits") > 0)
    # a hit document is a rare one: only its id, digest and positions travel
    found = kept_whole(found.select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), "hits").dropDuplicates(["of_id", "of_digest"]))
    rows = packed(docs, row_id=q(id_col), row_digest=F.xxhash64(q(text_col)))
    same = F.col("row_id").eqNullSafe(F.col("of_id")) & (F.col("row_digest") == F.col("of_digest"))
    if mode == "document":
        return unpacked(rows.join(found, same, "left_anti"), docs)

    @F.pandas_udf("string")
    def cut(text, hits):
        out = []
        for t, h in zip(text, hits, strict=True):
            if h is None or not len(h):
                out.append(t)
                continue
            data, at, kept = t.encode("utf-8"), 0, []
            for a, b in spans_of(t, list(h)):
                kept.append(data[at:a])
                at = b
            out.append(b"".join([*kept, data[at:]]).decode("utf-8"))
        return type(text)(out)

    return unpacked(rows.join(found, same, "left"), docs, **{text_col: cut(F.col("row").getField(text_col), F.col("hits"))})

"""Substring deduplication by hashed units: clauses, sentences, lines or paragraphs.

Units are normalised (ASCII lower case, white space collapsed) and hashed where the text is; only hashes, word counts and
places travel. Hashes are grouped over all documents, combined before the shuffle, so a unit that stands in a third of the
documents is one row a task. The earliest ranked occurrence stays (by document id, then place); later ones are repeats. A
single repeated unit may be a coincidence, so repeats are cut only in runs: consecutive units that are all repeats and hold
RUN_WORDS words together. Units of fewer than MIN_WORDS words neither break a run nor count in it; those inside a run go with it.
The result keeps the spans as offsets in the original text. Where documents with a cut are few, they alone travel to their spans.

A unit is named by 64 bits. A false repeat does harm only inside a run, so by chance of 25 words of collisions.

Defined cases: a null text has no units and stays null; null ids rank last; rows equal in id and text are one
document with one result; an empty table gives an empty result; input columns named like results give way to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import BROADCAST_ROWS, kept_whole, packed, unpacked
from stayflow.llm.simhash import LOWER

MIN_WORDS, RUN_WORDS = 2, 25
#: What ends a unit; the end belongs to the unit.
ENDS = {
    "clause": re.compile(r"[.!?,;:](?=[\x20\x09-\x0D])|\n"),
    "sentence": re.compile(r"[.!?](?=[\x20\x09-\x0D])|\n"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n\n+"),
}
#: Units in the broadcast spans of one document, on average, up to which BROADCAST_ROWS documents are broadcast.
SPANS = 16


def units_of(text: str, unit: str = "clause", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, words, hash) of the units that are long enough, as offsets in the text."""
    start = 0
    for end in [*(m.end() for m in ENDS[unit].finditer(text)), len(text)]:
        words = text[start:end].encode("utf-8", "surrogatepass").translate(LOWER).split()
        if len(words) >= min_words:
            yield start, end, len(words), xxhash.xxh3_64_intdigest(b" ".join(words))
        start = end


def units(docs: DataFrame, id_col: str, text_col: str, unit: str = "clause", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, units, words): hashes and word counts of the long enough units of every document, in order."""
    rows = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("digest"), q(text_col).cast("string").alias("text")).where("text is not null")
    fields = [StructField("units", ArrayType(LongType())), StructField("words", ArrayType(IntegerType()))]
    out = StructType([rows.schema["id"], rows.schema["digest"], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, words = [], []
            for text in b.column("text"):
                found = list(units_of(text.as_py(), unit, min_words))
                hashes.append([h - (1 << 64) if h >> 63 else h for *_, h in found])
                words.append([n for _, _, n, _ in found])
            made = [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), *made], ["id", "digest", "units", "words"])

    return rows.mapInArrow(cut, out)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "clause", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, place, words, kept_in): repeated units by their number among the long enough ones, with the id that keeps them."""
    marks = kept_whole(units(docs, id_col, text_col, unit, min_words))
    found = marks.select("id", "digest", F.posexplode(F.arrays_zip("units", "words")).alias("place", "u"))
    found = found.select("id", "digest", "place", F.col("u.units").alias("unit"), F.col("u.words").alias("words"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "place")
    shared = found.groupBy("unit").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written out, so that both sides of the join are plain exchanges and AQE can split a unit that stands everywhere
    later = found.join(kept_whole(shared.select("unit", "first")), "unit").where(rank != F.col("first"))
    return later.select("id", "digest", "place", "words", F.col("first.id").alias("kept_in"))


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "clause", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """(id, digest, runs, kept_in): first and last place of every run of a document, and the ids that keep its units."""
    later = repeats(docs, id_col, text_col, unit, min_words)
    listed = later.groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("place", "words", "kept_in"))).alias("found"))
    kind = later.schema["kept_in"].dataType
    run = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
    out = StructType([later.schema["id"], later.schema["digest"], StructField("runs", ArrayType(run)), StructField("kept_in", ArrayType(kind))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, runs, keepers = [], [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                own, ids, island = [], set(), []
                for u in [*found, None]:
                    if island and (u is None or u["place"] != island[-1]["place"] + 1):
                        if sum(x["words"] for x in island) >= run_words:
                            own.append({"first": island[0]["place"], "last": island[-1]["place"]})
                            ids.update(x["kept_in"] for x in island)
                        island = []
                    island.append(u)
                if own:
                    at.append(i)
                    runs.append(own)
                    keepers.append(sorted(ids, key=lambda x: (x is None, x)))
            if at:
                taken = [b.column(c).take(pa.array(at)) for c in ("id", "digest")]
                types = [pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(b.schema.field("found").type.value_type.field("kept_in").type)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(runs, types[0]), pa.array(keepers, types[1])], ["id", "digest", "runs", "kept_in"])

    return listed.mapInArrow(join, out)


def dedup_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "clause", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """The input with repeated runs cut out of its texts, `removed` (spans of the original text) and `kept_in` (ids)."""
    runs = kept_whole(repeated_runs(docs, id_col, text_col, unit, min_words, run_words).withColumnsRenamed({"id": "of_id", "digest": "of_digest"}))
    n, spans = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs") + F.size("kept_in")), F.lit(0))).first()
    rows = packed(docs, row_id=q(id_col), row_digest=F.xxhash64(q(text_col)))
    same = F.col("row_id").eqNullSafe(F.col("of_id")) & (F.col("row_digest") == F.col("of_digest"))

    @F.pandas_udf("struct<removed: array<struct<start: bigint, `end`: bigint>>, clean: string>")
    def without(texts, firsts, lasts):
        import pandas as pd

        removed, clean = [], []
        for text, a, b in zip(texts, firsts, lasts, strict=True):
            if a is None or text is None:
                removed.append(None)
                clean.append(None)
                continue
            places = [(s, e) for s, e, _, _ in units_of(text, unit, min_words)]
            cuts = [(places[x][0], places[y][1]) for x, y in zip(a, b, strict=True)]
            edges = [0, *(x for c in cuts for x in c), len(text)]
            removed.append([{"start": s, "end": e} for s, e in cuts])
            clean.append("".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        return pd.DataFrame({"removed": removed, "clean": clean})

    joined = rows.join(F.broadcast(runs) if max(n, spans // SPANS) <= BROADCAST_ROWS else runs, same, "left")
    text = F.col("row").getField(text_col).cast("string")
    hit = F.col("runs").isNotNull()
    joined = joined.withColumn("done", without(F.when(hit, text), F.col("runs.first"), F.col("runs.last")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return unpacked(
        joined, docs, **{
            text_col: F.when(hit, F.col("done.clean")).otherwise(F.col("row").getField(text_col)),
            "removed": F.coalesce("done.removed", none),
            "kept_in": F.coalesce("kept_in", F.array().cast(dict(joined.dtypes)["kept_in"])),
        },
    )

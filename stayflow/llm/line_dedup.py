"""Line deduplication by winnowing.

The hash of every line is taken. A window is `run` lines, or fewer lines that hold `words` words together; its fingerprint is
the rightmost least hash in it. Two equal windows have equal fingerprints at equal places: a repeated run is found for certain.
Fingerprints with a single position are dropped by a grouped minimum and maximum. The positions that remain are
a filter only: every window that has such a fingerprint is grouped by the digest of its content, and the earliest of a
group is the source of the others, which leaves one row a window instead of one a pair. (Joined by the earliest position of
a line alone, a run whose line stood elsewhere before, in other company, would be missed; joined by all, a line that
stands everywhere would make the square of its count.) Windows that overlap or follow each other with the same source are one run.

A line is thus deleted if and only if it lies in a window that occurs earlier, in order of document id and line. Lines are
compared with white space collapsed; blank lines count as no lines and stay.

Defined cases: a null text has no lines and stays null; null ids come last; rows equal in id and text are one
document with one result; texts without a window lose nothing; an empty table gives an empty result;
input columns named like results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import BLANK_RUN, BROADCAST_ROWS, WORD, kept_whole, packed, unpacked

RUN, WORDS = 3, 50
#: Deleted lines of a document, on average, up to which BROADCAST_ROWS documents are broadcast.
LINES = 32


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BLANK_RUN, " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rank(*columns: str) -> Column:
    """Order of documents and lines: by id, null last, then by text digest and line."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", *columns)


def windows(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(id, digest, at, size, fingerprint, place, content): every window, the place of its fingerprint and the digest of
    its text. One pass over the texts, no shuffle."""
    lines = F.filter(F.transform(_lines(q(text_col)), _normal), lambda x: x != "")
    rows = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("digest"), lines.alias("lines")).where(F.size("lines") > 0)
    hashed = rows.withColumns({"h": F.transform("lines", lambda x: F.xxhash64(x)), "n": F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD)))})

    def windows_of(size: int) -> Column:
        def window(at: Column) -> Column:
            part = F.reverse(F.slice("h", at + 1, size))
            least = F.array_min(part)
            return F.struct(
                at.alias("at"), F.lit(size).alias("size"), least.alias("fingerprint"), (at + size - F.array_position(part, least)).cast("int").alias("place"),
                F.unhex(F.md5(F.array_join(F.slice("lines", at + 1, size), "\n"))).alias("content"),
            )

        def full(at: Column) -> Column:
            return F.aggregate(F.slice("n", at + 1, size), F.lit(0), lambda a, b: a + b) >= words

        places = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(places if size == run else F.filter(places, full), window)

    every = F.concat(*[windows_of(size) for size in range(1, run + 1)])
    return hashed.select("id", "digest", F.explode(every).alias("w")).select("id", "digest", "w.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """(id, digest, start, end, source_id, source_start): maximal later runs, in numbers of non-blank lines."""
    found = kept_whole(windows(docs, id_col, text_col, run, words))
    place = _rank("place")
    # a window's length and first line belong to its place: windows that share a fingerprint in one document are several positions
    shared = found.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last"))
    candidates = found.join(shared.select("fingerprint"), "fingerprint", "left_semi")
    earliest = candidates.groupBy("content").agg(F.min(_rank("at")).alias("source"), F.max(_rank("at")).alias("last"))
    earliest = earliest.where(F.col("source") != F.col("last")).select("content", "source")
    later = candidates.join(earliest, "content").where(_rank("at") != F.col("source"))
    match = ["id", "digest", "source_id", "source_digest", "shift"]
    later = later.select(
        "id", "digest", "at", "size", F.col("source.id").alias("source_id"), F.col("source.digest").alias("source_digest"),
        (F.col("source.at") - F.col("at")).alias("shift"),
    ).groupBy(*match, "at").agg(F.max("size").alias("size"))
    order = Window.partitionBy(*match).orderBy("at")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("fresh", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1)))
    return begun.withColumn("island", F.sum("fresh").over(order)).groupBy(*match, "island").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end")
    ).select("id", "digest", "start", "end", "source_id", (F.col("start") + F.col("shift")).alias("source_start"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """The input with its texts less the repeated runs, and n_lines, n_deleted and the numbers of the deleted lines."""
    runs = repeated_runs(docs, id_col, text_col, run, words)
    gone = runs.groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))))).alias("gone")
    )
    gone = kept_whole(gone)
    n, numbers = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if max(n, numbers // LINES) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)  # few documents lose lines: the texts stay where they are
    rows = packed(docs, row_id=q(id_col), row_digest=F.xxhash64(q(text_col)))
    same = F.col("row_id").eqNullSafe(F.col("of_id")) & (F.col("row_digest") == F.col("of_digest"))
    text = F.col("row").getField(text_col)
    joined = rows.join(gone, same, "left").withColumn("lines", _lines(text))
    filled = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _normal(F.col("lines")[i]) != "")
    joined = joined.withColumn("filled", filled).withColumn("deleted", F.transform("gone", lambda p: F.col("filled")[p]))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("deleted"))
    clean = F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n")
    return unpacked(
        joined, docs, **{
            text_col: F.when(F.col("deleted").isNull(), text).otherwise(clean), "n_lines": F.size("filled").cast("long"),
            "n_deleted": F.coalesce(F.size("deleted"), F.lit(0)).cast("long"),
            "deleted_lines": F.coalesce("deleted", F.array().cast("array<int>")),
        },
    )

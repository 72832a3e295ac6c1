"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints (64 bits over word shingles) that differ in at most 4 bits are linked. Cut into three segments, two
linked fingerprints have one segment with at most one differing bit (three segments with two each would make
six). So each fingerprint is indexed under 64 keys: a segment with one bit blanked out, for each bit. Two
segments at most one bit apart share the key that blanks that bit. An equality join on the keys finds the
candidates, and the join itself verifies the distance; of the keys a pair shares, only one reports it.

Equal fingerprints are one row before anything is indexed. Keys that more than `hot` fingerprints share are not
joined as they are: the rest of the fingerprint is cut into five pieces, of which a linked pair has one in
common; members link to the least fingerprint that shares the piece, and after that only members outside their
group's largest class are compared with the group. Links that would join what is joined already are skipped,
never a link between classes, whatever the size.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; null ids never name a
class unless a class has no other; repeated rows are in one class, and `near_dedup` keeps one of them; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole, packed, unpacked
from stayflow.llm.components import components

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints under one key before the key counts as hot.
HOT = 1024
PIECES = 5
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 22
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
BYTE_PLACE = np.arange(8) * 256


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def word_chunks(data: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """Words of a long text in pieces that end between words."""
    start = 0
    while start < len(data):
        end = start + size
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[start:end].split()
        start = end


def _bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles of these words, and how many shingles there are."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n].tolist(), (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
    by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
    return (by_byte @ BIT_OF_BYTE).ravel(), n


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of one text."""
    total, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
        if tail := tail + words:
            if len(tail) >= SHINGLE:
                counts, more = _bit_counts(tail)
                total, n = total + counts, n + more
                tail = tail[-(SHINGLE - 1) :]
    if not n:
        if not tail:
            return 0
        total, n = _bit_counts(tail)
    return _signed(int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, digest) of every row; `digest` tells rows of one id apart. Arrow batches, one text at a time."""
    rows = docs.select(q(id_col).alias("id"), q(text_col).cast("string").alias("text"), F.xxhash64(q(text_col)).alias("digest"))
    out = StructType([rows.schema["id"], StructField("fp", LongType()), StructField("digest", LongType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), fp, b.column("digest")], ["id", "fp", "digest"])

    return rows.mapInArrow(of_batches, out)


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(_signed(mask)).cast("long"))


def _segment(bit: int) -> tuple[int, int]:
    return next(s for s in SEGMENTS if s[0] <= bit < s[1])


def variants(fps: DataFrame) -> DataFrame:
    """(k, value, fp): the segment of bit k with that bit blanked out, for all 64 bits."""
    keys = [_and(F.col("fp"), _mask(*_segment(k)) & ~(1 << k)) for k in range(64)]
    return fps.select(F.posexplode(F.array(*keys)).alias("k", "value"), "fp")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _reports(k: Column, x: Column) -> Column:
    """Whether k is the key that reports a pair with difference x: in the first segment that has at most one
    differing bit, that bit, or the segment's lowest bit if there is none."""
    found = F.lit(False)
    for lo, hi in reversed(SEGMENTS):
        part = _and(x, _mask(lo, hi))
        one = F.expr("shiftleft(1L, l.k)")
        found = F.when(
            F.bit_count(part) <= 1, k.between(lo, hi - 1) & (((part == 0) & (k == lo)) | (part == one))
        ).otherwise(found)
    return found


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v): pairs of distinct fingerprints at most `BITS` bits apart, enough of them to join all that are linked.

    Without hot keys these are all pairs, each once.
    """
    index = variants(fps)
    values = [F.struct(F.lit(s[0]).alias("lo"), _and(F.col("fp"), _mask(*s)).alias("part")) for s in SEGMENTS]
    shared = fps.select(F.explode(F.array(*values)).alias("s")).groupBy("s.lo", "s.part").count()
    # a key joins two segment values, so one of at most `hot` rows needs both below hot / 2
    heavy = kept_whole(shared.where(F.col("count") > hot // 2))
    if heavy.isEmpty():
        return _plain_links(index)
    keys = None
    for lo, hi in SEGMENTS:
        blanked = [_and(F.col("part"), _mask(lo, hi) & ~(1 << k)) for k in range(lo, hi)]
        of_segment = heavy.where(F.col("lo") == lo).select(F.posexplode(F.array(*blanked)).alias("at", "value"))
        of_segment = of_segment.select((F.col("at") + lo).alias("k"), "value")
        keys = of_segment if keys is None else keys.unionByName(of_segment)
    keys = kept_whole(keys.distinct())
    plain = kept_whole(_plain_links(index.join(keys, ["k", "value"], "left_anti")))
    return plain.unionByName(_hot_links(index.join(keys, ["k", "value"], "left_semi"), plain))


def _plain_links(index: DataFrame) -> DataFrame:
    left, right = index.alias("l"), index.alias("r")
    a, b = F.col("l.fp"), F.col("r.fp")
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.value") == F.col("r.value"))
    near = (a < b) & (_distance(a, b) <= BITS) & _reports(F.col("l.k"), a.bitwiseXOR(b))
    return left.join(right, same & near).select(a.alias("u"), b.alias("v"))


def _pieces(lo: int, hi: int) -> list[int]:
    """Masks of the bits outside a segment, cut into PIECES runs."""
    rest = [i for i in range(64) if not lo <= i < hi]
    return [sum(1 << i for i in rest[len(rest) * t // PIECES : len(rest) * (t + 1) // PIECES]) for t in range(PIECES)]


def _hot_links(rows: DataFrame, plain: DataFrame) -> DataFrame:
    """Links among the members of hot keys, less those inside a class that other links make already."""
    cut = F.lit(None)
    for lo, hi in SEGMENTS:
        cut = F.when(F.col("k").between(lo, hi - 1), F.array(*[_and(F.col("fp"), m) for m in _pieces(lo, hi)])).otherwise(cut)
    members = rows.select("k", "value", "fp", F.posexplode(cut).alias("t", "piece"))
    group = ["k", "value", "t", "piece"]
    pivot = members.groupBy(*group).agg(F.min("fp").alias("v"))
    near_pivot = members.join(pivot, group).where((F.col("fp") != F.col("v")) & (_distance(F.col("fp"), F.col("v")) <= BITS))
    stars = kept_whole(near_pivot.select(F.col("fp").alias("u"), "v").distinct())
    roots = components(stars.unionByName(plain))
    classed = members.join(roots, F.col("fp") == F.col("node"), "left").select(*group, "fp", F.coalesce("root", "fp").alias("class"))
    classed = kept_whole(classed)
    largest = classed.groupBy(*group, "class").count().groupBy(*group).agg(F.max_by("class", "count").alias("largest"))
    outside = classed.join(largest, group).where(F.col("class") != F.col("largest")).select(*group, F.col("fp").alias("u"), F.col("class").alias("own"))
    across = outside.join(classed, group).where((F.col("own") != F.col("class")) & (_distance(F.col("u"), F.col("fp")) <= BITS))
    return stars.unionByName(across.select("u", F.col("fp").alias("v")).distinct())


def _classes(marks: DataFrame, hot: int) -> DataFrame:
    """fp -> component (least id of all rows reachable), for checkpointed fingerprints."""
    distinct = kept_whole(marks.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), hot))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written out, so that both sides of the join are plain exchanges and AQE can split a class with many fingerprints
    least = kept_whole(rooted.groupBy("root").agg(F.min("least").alias("component")))
    return rooted.join(least, "root").select("fp", "root", "component")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: its fingerprint and the least id it is linked to, over any number of steps."""
    marks = kept_whole(fingerprints(docs, id_col, text_col))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(_classes(marks, hot), "fp").select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One document of each class: the least id (then the least text digest). Of equal rows one stays."""
    marks = kept_whole(fingerprints(docs, id_col, text_col))
    return first_of_each(docs, marks.join(_classes(marks, hot).select("fp", "root"), "fp"), id_col, text_col)


def first_of_each(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that come first in their class, by (root, id, digest) of every row."""
    alike = named.groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "n")).alias("k")
    keepers = kept_whole(alike.groupBy("root").agg(first).select("k.id", "k.digest", "k.n"))
    rows = packed(docs, row_id=q(id_col), row_digest=F.xxhash64(q(text_col)))
    kept = rows.join(keepers, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_digest") == F.col("digest")))
    single = kept.where(F.col("n") == 1)
    repeated = kept.where(F.col("n") > 1).dropDuplicates(["row_id", "row_digest"])
    return unpacked(single.unionByName(repeated), docs)

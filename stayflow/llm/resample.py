"""Importance resampling towards a target distribution.

Features are the runs of 1 to `gram` consecutive words of a text, hashed into `buckets` buckets. The corpus and the target
texts are counted by bucket in one pass each (a task sends one row a bucket); the gain of a bucket is its floored
log ratio, an array of fixed length that goes to the tasks. A second pass scores every text on that array. Gumbel noise
from a hash of the id makes the highest scores a weighted draw without replacement.

The cutoff is found without sorting the corpus: a quantile sketch brackets it, exact counts of the scores above and inside
the bracket validate the bracket or widen it, and only the rows inside are sorted. Ranks are counted inside value ranges.

Defined cases: a null text has no words and counts as empty; texts of fewer than `least_words` words are scored and never
drawn; a null id is hashed as an empty one and comes last among ties, then the text digest decides; of rows equal in id
and text as many are drawn as places are left; an empty target gives every bucket the target's smoothing alone; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayflow.functions.columns import q
from stayflow.llm.common import kept_whole
from stayflow.llm.decontaminate import CHUNK, WORD, words_of
from stayflow.operators.ordered import global_positions

GRAM, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Rank error of the first sketch as a share of the rows; the bracket spans four times as much.
ERROR = 0.002


def bucket_chunks(text: str | None, gram: int = GRAM, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of a text, some megabytes at a time."""
    data, start, tail = words_of(text or ""), 0, []
    while start < len(data):
        end = start + CHUNK
        while end < len(data) and WORD.match(data, end):
            end += 1
        new = WORD.findall(data, start, end)
        start = end
        hashes = [np.fromiter(map(zlib.crc32, new), np.int64, len(new))]
        words = tail + new
        for size in range(2, gram + 1):
            runs = (b" ".join(words[i - size + 1 : i + 1]) for i in range(max(len(tail), size - 1), len(words)))
            hashes.append(np.fromiter(map(zlib.crc32, runs), np.int64))
        tail = words[len(words) - gram + 1 :] if gram > 1 else []
        yield len(new), np.concatenate(hashes) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; at most `buckets` rows leave a task, as many reach the driver."""
    rows = texts.select(q(text_col).cast("string").alias("text")).where("text is not null")

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column("text"):
                for _, found in bucket_chunks(t.as_py(), gram, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(of_partition, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s, t = bucket_counts(docs, text_col, gram, buckets).astype(float), bucket_counts(target, target_text, gram, buckets).astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, digest, n_words, n_features, weight) of every row."""
    rows = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("digest"), q(text_col).cast("string").alias("text"))
    numbers = ["n_words", "n_features", "weight"]
    out = StructType([rows.schema["id"], rows.schema["digest"], *[StructField(c, LongType()) for c in numbers]])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.zeros((len(numbers), b.num_rows), np.int64)
            for i, t in enumerate(b.column("text")):
                for words, found in bucket_chunks(t.as_py(), gram, len(gain)):
                    made[:, i] += words, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), *map(pa.array, made)], ["id", "digest", *numbers])

    return rows.mapInArrow(of_batches, out)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first eight hex digits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def cutoff_bracket(scores: DataFrame, rows: int, k: int, error: float = ERROR) -> tuple[float, float, int]:
    """(low, high, rows above high) of column `score`, so that the k-th highest lies between low and high, both included."""
    at = 1 - k / rows
    while True:
        low, high = float("-inf"), float("inf")
        if error < 0.25:
            sketch = scores.approxQuantile("score", [max(0.0, at - 2 * error), min(1.0, at + 2 * error)], error)
            low = sketch[0] if at - 2 * error > 0 else low
            high = sketch[1] if at + 2 * error < 1 else high
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        error *= 4


def _ranked(rows: DataFrame) -> DataFrame:
    ordered = rows.withColumns({"down": -F.col("score"), "no_id": F.col("id").isNull()})
    return global_positions(ordered, "down", "rank", ["no_id", "id", "digest"]).drop("down", "no_id")


def cutoff(scores: DataFrame, k: int, rows: int, error: float = ERROR) -> Column:
    """Whether a row of `scores` (id, digest, score) is among the k highest, ties to the smaller id; rows equal to the k-th all are."""
    if k >= rows:
        return F.lit(True)
    low, high, above = cutoff_bracket(scores, rows, k, error)
    inside = scores.where(F.col("score").between(low, high)).select("score", "id", "digest")
    last = _ranked(inside).where(F.col("rank") == k - above).first()
    if last["id"] is None:
        earlier = F.col("id").isNotNull() | (F.col("digest") <= last["digest"])
    else:
        earlier = F.coalesce((F.col("id") < F.lit(last["id"])) | ((F.col("id") == F.lit(last["id"])) & (F.col("digest") <= last["digest"])), F.lit(False))
    return (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & earlier)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, gram: int = GRAM, buckets: int = BUCKETS, seed: int = SEED, error: float = ERROR,
) -> DataFrame:
    """One row per document: n_words, n_features, weight, score, and rank if it is drawn."""
    gain = gains(docs, target, text_col, target_text, gram, buckets)
    found = weights(docs, gain, id_col, text_col, gram)
    found = kept_whole(found.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = F.col("n_words") >= least_words
    n = found.where(able).count()
    k = percent * n // 100
    taken = able & (cutoff(found.where(able), k, n, error) if k else F.lit(False))
    # rows equal to the last one drawn are ranked with it; those beyond the k-th place are not drawn
    ranked = _ranked(found.where(taken)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    both = ranked.unionByName(found.where(~taken).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")

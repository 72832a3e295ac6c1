"""Exact deduplication by a stateful stream.

A stream reads the table in bounded micro-batches. Its keyed state, held on disk by the RocksDB provider and
never expired, has one entry per digest of a normalised text: the number of rows, and the first row by stable
identifier with the locator of its content (file and row index). Each batch appends the entries it changed to a
ledger, so the last entry of a digest is its state.

Digests that were seen more than once are hits, and hits are checked on the full bytes: their texts are grouped
by digest and text. Should two texts ever share a digest, their rows are regrouped by the text itself.

Defined cases: a null text counts as empty; a null id comes after all others, and a group whose ids are all null
has a null keep_id; of rows equal in text and id the first by locator stays, so exactly one row of each group
is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.llm.common import BLANK_RUN, kept_whole, over_salts, salt_of
from stayflow.session import shared_path

#: Input bytes of one micro-batch; 30 GB make several.
BATCH_BYTES = 4 << 30
#: Copies of one text meet in this many tasks, not in one.
SALTS = 32
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: files take the room they fill, not a preallocated block each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
LEDGER = "digest string, n long, first struct<no_id: boolean, id: {id}, file: string, at: long>"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def full_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _identified(rows: DataFrame, id_col: str, text_col: str, digest, *more: str) -> DataFrame:
    """(digest, first): the row's stable identifier and content locator beside the digest; `norm`, `sha` on request."""
    where = dict(no_id=q(id_col).isNull(), id=q(id_col), file=F.col("_metadata.file_path"), at=F.col("_metadata.row_index"))
    norm = normalised(q(text_col))
    extra = {"norm": norm, "sha": full_digest(norm)}
    return rows.select(
        digest(norm).alias("digest"), F.struct(*[c.alias(n) for n, c in where.items()]).alias("first"), *[extra[m].alias(m) for m in more]
    )


def run_ledger(spark: SparkSession, path: str, id_col: str, text_col: str, digest, folder: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Runs the stream over what `path` holds now and returns the state: digest -> n, first.

    Called again with the same folder, it goes on from the stored state with the files added since.
    """
    schema = spark.read.parquet(path).schema
    id_type = schema[id_col].dataType.simpleString()
    ledger = f"{folder}/ledger"

    def changed(batch: DataFrame, batch_id: int) -> None:
        # a batch that runs again writes its own folder again
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    with _settings(spark, STATE):
        # as a pattern the path may be one file as well as a folder
        pattern = f"{path[:-1]}[{path[-1]}]"
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)
        state = _identified(stream, id_col, text_col, digest).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
        )
        query = (
            state.writeStream.outputMode("update").foreachBatch(changed)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    entry = LEDGER.format(id=id_type)
    spark.createDataFrame([], entry).write.mode("overwrite").parquet(f"{ledger}/batch=-1")  # there also when no batch ran
    entries = spark.read.schema(f"{entry}, batch long").parquet(ledger)
    last = entries.groupBy("digest").agg(F.max_by(F.struct("n", "first"), "batch").alias("state"))
    return last.select("digest", "state.n", "state.first")


def dedup_exact(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=full_digest,
    folder: str | None = None, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the kept row's locator."""
    folder = folder or shared_path(spark, "exact-dedup")
    hits = run_ledger(spark, path, id_col, text_col, digest, folder, batch_bytes).where(F.col("n") > 1)
    docs = spark.read.parquet(path)
    salted_hits = over_salts(hits, SALTS).withColumnRenamed("first", "keeper")
    own_salt = salt_of(SALTS, F.col("first.id"), F.col("first.at"))

    # full bytes of the hits: copies of a text meet in SALTS tasks first and leave those as one row each
    texts = _identified(docs, id_col, text_col, digest, "norm").select("digest", "norm", own_salt.alias("salt"))
    of_hits = texts.join(salted_hits.select("digest", "salt"), ["digest", "salt"], "left_semi")
    variants = of_hits.groupBy("digest", "norm").count().groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = variants.where(F.col("texts") > 1).select("digest")

    sha = [] if digest is full_digest else ["sha"]
    rows = _identified(docs, id_col, text_col, digest, *sha).withColumn("salt", own_salt)
    result = rows.join(salted_hits, ["digest", "salt"], "left").select(
        "digest", "first", *sha, F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("keeper", "first").alias("keeper"),
    )
    if not clashes.isEmpty():
        clashes = kept_whole(clashes)
        result = result.join(clashes, "digest", "left_anti").unionByName(
            _by_text(_identified(docs, id_col, text_col, digest, "norm", *sha), clashes).select(*result.columns)
        )
    return result.select(
        F.col("first.id").alias(id_col), F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("first") == F.col("keeper")).alias("kept"), F.col("sha" if sha else "digest").alias("text_sha256"),
        F.col("keeper.file").alias("keep_file"), F.col("keeper.at").alias("keep_row"),
    )


def _by_text(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows whose digest stands for several texts, grouped by the text itself."""
    rows = rows.join(clashes, "digest", "left_semi")
    groups = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("keeper"))
    return rows.join(groups, ["digest", "norm"])

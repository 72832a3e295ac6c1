"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.llm import (
    decontaminate, exact_dedup, language_id, line_dedup, mixing, ngram_lm, quality, resample, sharding, simhash, spelling, substring_dedup,
    token_counts,
)
from stayflow.llm.common import documents
from stayflow.llm.sql import ORACLE  # noqa: F401  the entry module reads it here

SHARDS = 16


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_lines", "n_deleted", F.array_join(F.col("deleted_lines").cast("array<string>"), ",").alias("deleted_lines"),
        F.sha2("text", 256).alias("clean_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_units(documents(spark, sf_dir))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return done.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"),
        F.array_join(F.col("kept_in").cast("array<string>"), ",").alias("kept_in"), F.sha2("text", 256).alias("clean_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_exact(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def sites_of(docs: DataFrame) -> tuple[Column, Column]:
    """Documents name no address: the source is the host, the language of a source its path."""
    return F.col("source"), F.col("lang")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), *sites_of(docs))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sharding.shard_places(documents(spark, sf_dir), SHARDS)
    return places.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.language_scores(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_resample": op11_resample,
    "op12_spelling": op12_spelling,
    "op13_language_model": op13_language_model,
}

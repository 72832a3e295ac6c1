"""Stateless streaming scorer: JSON or Parquet profiles in, prediction records out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stayflow.operators.scoring import predict_churn_batch
from stayflow.schemas import PROFILE_SCHEMA


def read_profiles(spark: SparkSession, path: str, fmt: str = "json", max_files_per_trigger: int = 1000) -> DataFrame:
    """Profiles as a stream; absent JSON fields arrive as null and take their defaults later."""
    return (
        spark.readStream.schema(PROFILE_SCHEMA).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )


def start_scoring(
    spark: SparkSession, model: PipelineModel, in_path: str, out_path: str, checkpoint: str, model_version: str,
    fmt: str = "json", interval: str | None = None,
) -> StreamingQuery:
    """Appends predictions as Parquet. Without an interval it works off what is there and stops.

    The feature stage must have been fitted with medianScope="fit": a stream has no medians of its own.
    """
    scored = predict_churn_batch(model, read_profiles(spark, in_path, fmt), model_version)
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(out_path)

"""Batch scoring and lookups."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.functions.rules import prediction_columns
from stayflow.operators.metrics import positive_probability
from stayflow.operators.ordered import global_positions
from stayflow.schemas import CATEGORICAL_COLS, ID_COL, PROFILE_DEFAULTS


def apply_defaults(df: DataFrame) -> DataFrame:
    """Request-like records: an absent column or value takes its fixed default."""
    present = set(df.columns)
    out = {}
    for name, default in PROFILE_DEFAULTS.items():
        value = F.lit(default if name in CATEGORICAL_COLS else float(default))
        out[name] = F.coalesce(q(name), value) if name in present else value
    return df.withColumns(out)


def batch_ids(df: DataFrame, seq_col: str, id_col: str = ID_COL) -> DataFrame:
    """`customer_id`: the caller's id if there is one, else BATCH_0001 and so on from the caller's position column."""
    made = F.format_string("BATCH_%04d", q(seq_col))
    given = q(id_col).cast("string") if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn("customer_id", F.coalesce(given, made))


def with_positions(df: DataFrame, key_col: str, out_col: str = "seq") -> DataFrame:
    """Positions in the order of a unique numeric key, for callers without a position column."""
    return global_positions(df, key_col, out_col)


def score_rows(scored: DataFrame, model_version: str, probability_col: str = "p", id_col: str = "customer_id") -> DataFrame:
    """Prediction records of rows that already carry a probability."""
    return scored.select(q(id_col).cast("string").alias("customer_id"), *prediction_columns(q(probability_col), model_version))


def predict_churn_batch(
    model: PipelineModel, df: DataFrame, model_version: str, defaults: bool = True, seq_col: str | None = None
) -> DataFrame:
    """Scores a table (or stream) of profiles with a saved pipeline; no Python per row.

    With `seq_col`, the caller's 1-based positions, rows without an id are BATCH_0001 and so on; without, as single
    records, they are N/A.
    """
    rows = apply_defaults(df) if defaults else df
    if seq_col is not None:
        rows = batch_ids(rows, seq_col)
    elif "customer_id" not in rows.columns:
        given = F.col(ID_COL).cast("string") if ID_COL in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("customer_id", F.coalesce(given, F.lit("N/A")))
    return score_rows(model.transform(rows).withColumn("_p", positive_probability()), model_version, "_p")


def find_customers(df: DataFrame, wanted: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Rows of the requested ids, compared as text."""
    ids = wanted.select(q(id_col).cast("string").alias("_w"))
    return df.join(ids, q(id_col).cast("string") == F.col("_w"), "left_semi")


def unknown_customers(wanted: DataFrame, df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Requested ids that the table does not have."""
    ids = wanted.select(q(id_col).cast("string").alias(id_col)).distinct()
    known = df.select(q(id_col).cast("string").alias("_k"))
    return ids.join(known, q(id_col) == F.col("_k"), "left_anti")

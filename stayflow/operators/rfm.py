"""Recency, frequency and monetary value per customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import nan_to_null, q
from stayflow.schemas import require_columns

RFM_COLS = ["Recency", "Frequency", "Monetary"]
MICROS_PER_DAY = 86_400_000_000


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour days between two timestamps, floored (also below zero); datediff counts midnights instead."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def build_rfm_table(
    df: DataFrame,
    customer_col: str = "Customer ID",
    invoice_col: str = "Invoice",
    date_col: str = "InvoiceDate",
    amount_col: str = "TotalAmount",
    snapshot_date: dt.datetime | str | None = None,
) -> DataFrame:
    """One row per customer: whole days since the last purchase, distinct invoices, total amount.

    Two aggregations instead of a distinct count: first per (customer, invoice), then per customer. Both
    combine on the map side, so a customer with a third of all rows never lands in one task unreduced.
    The default snapshot (one day after the last purchase of anyone) is the maximum over the per-customer
    rows, read back as a one-row scalar subquery. The subquery asks for the whole per-customer row, so its
    plan equals the main one below the filter and Spark reuses that shuffle instead of scanning twice.
    """
    require_columns(df, [customer_col, invoice_col, date_col, amount_col], "transactions")
    per_invoice = (
        df.filter(q(customer_col).isNotNull())
        .groupBy(q(customer_col).alias(customer_col), q(invoice_col).alias("_invoice"))
        .agg(F.max(q(date_col)).alias("_last"), F.sum(q(amount_col)).alias("_amount"))
    )
    per_customer = per_invoice.groupBy(q(customer_col)).agg(
        F.max("_last").alias("_last"),
        F.count("_invoice").alias("Frequency"),
        F.sum("_amount").alias("Monetary"),
    )
    if snapshot_date is None:
        newest = per_customer.agg(F.max(F.struct("_last", "Frequency", "Monetary")).alias("_newest")).scalar()
        snapshot = newest.getField("_last") + F.expr("INTERVAL 1 DAY")
    else:
        snapshot = F.lit(snapshot_date).cast("timestamp")
    return per_customer.filter(nan_to_null(F.col("Monetary")) > 0).select(
        q(customer_col),
        whole_days(snapshot, F.col("_last")).alias("Recency"),
        F.col("Frequency"),
        F.col("Monetary"),
    )

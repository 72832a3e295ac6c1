"""Cleaning of transactions and profiles: narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stayflow.functions.columns import id_string, q
from stayflow.schemas import ID_COL, TARGET_COL, require_columns

# Spellings to unify, matched exactly.
RECODES = {
    "PreferredLoginDevice": {"Phone": "Mobile Phone"},
    "PreferredPaymentMode": {"CC": "Credit Card", "COD": "Cash on Delivery"},
    "PreferedOrderCat": {"Mobile": "Mobile Phone"},
}


def valid_sales(df: DataFrame, customer_col: str = "Customer ID") -> DataFrame:
    """Comparisons stay on the raw columns so that they push down into the scan."""
    types = dict(df.dtypes)
    keep = q(customer_col).isNotNull() & (F.col("Quantity") > 0) & (F.col("Price") > 0)
    for c in (customer_col, "Quantity", "Price"):
        if types[c] in ("double", "float"):
            keep = keep & ~F.isnan(q(c))
        elif types[c] == "string":
            keep = keep & ~F.isnan(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    return df.filter(keep)


def clean_retail_data(df: DataFrame, customer_col: str = "Customer ID", lenient_dates: bool = False) -> DataFrame:
    """Valid sales with a text customer id, a parsed date and `TotalAmount`."""
    require_columns(df, [customer_col, "Quantity", "Price", "InvoiceDate"], "retail data")
    parse = F.try_to_timestamp if lenient_dates else F.to_timestamp
    return (
        valid_sales(df, customer_col)
        .withColumn(customer_col, id_string(q(customer_col), dict(df.dtypes)[customer_col]))
        .withColumn("InvoiceDate", parse(F.col("InvoiceDate")))
        .withColumn("TotalAmount", F.col("Quantity") * F.col("Price"))
    )


def clean_retail_observed(df: DataFrame, customer_col: str = "Customer ID") -> tuple[DataFrame, Observation, Observation]:
    """Cleaned rows plus row counts before and after, filled in by whichever action runs first."""
    before, after = Observation(), Observation()
    cleaned = clean_retail_data(df.observe(before, F.count(F.lit(1)).alias("rows")), customer_col)
    return cleaned.observe(after, F.count(F.lit(1)).alias("rows")), before, after


def retail_retention(df: DataFrame, customer_col: str = "Customer ID") -> DataFrame:
    """Rows before, rows kept and the kept share in percent, in one pass."""
    kept = q(customer_col).isNotNull() & ~F.isnan(q(customer_col).cast("double"))
    for c in ("Quantity", "Price"):
        kept = kept & (F.col(c) > 0) & ~F.isnan(F.col(c).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("initial_rows"), F.count_if(kept).alias("final_rows")).withColumn(
        "retained_pct", F.try_divide(F.col("final_rows") * 100.0, F.col("initial_rows"))
    )


def clean_churn_data(df: DataFrame) -> DataFrame:
    """Text id, integer target, unified category spellings; other values and nulls stay."""
    require_columns(df, [ID_COL, TARGET_COL, *RECODES], "churn data")
    out = df.withColumn(ID_COL, id_string(F.col(ID_COL), dict(df.dtypes)[ID_COL])).withColumn(TARGET_COL, F.col(TARGET_COL).cast("int"))
    for name, mapping in RECODES.items():
        out = out.replace(mapping, subset=[name])
    return out


def dataset_summary(retail: DataFrame, churn: DataFrame, customer_col: str = "Customer ID") -> DataFrame:
    """Rows, columns, customers and churn rate of both inputs.

    Customers are deduplicated by a shuffle on the id, so a hot customer shrinks to one row per map task.
    """
    per_customer = retail.groupBy(q(customer_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    r = per_customer.agg(
        F.lit("retail").alias("dataset"),
        F.sum("n").alias("n_rows"),
        F.lit(len(retail.columns)).alias("n_columns"),
        F.count("id").alias("n_customers"),
        F.lit(None).cast("double").alias("churn_rate_pct"),
    )
    per_id = churn.groupBy(F.col(ID_COL).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET_COL).alias("lost"))
    c = per_id.agg(
        F.lit("churn").alias("dataset"),
        F.sum("n").alias("n_rows"),
        F.lit(len(churn.columns)).alias("n_columns"),
        F.count("id").alias("n_customers"),
        (F.try_divide(F.sum("lost"), F.sum("n")) * 100).alias("churn_rate_pct"),
    )
    return r.unionByName(c)


def preview(df: DataFrame, n: int = 2) -> DataFrame:
    return df.limit(n)

"""Segments joined with churn risk: integrated table, cross-tab, action cohorts, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import hash_uniform, nan_to_null, q
from stayflow.functions.rules import (
    HIGH, LOW, MEDIUM, TIERS, fallback_cluster, fallback_persona, recommended_action, risk_tier,
)
from stayflow.operators.quantiles import exact_quantiles
from stayflow.operators.segmentation import assign_personas, profile_clusters
from stayflow.schemas import ID_COL

TOTAL = "Total"


def id_overlap(rfm: DataFrame, churn: DataFrame, rfm_id: str = "Customer ID") -> DataFrame:
    """One row with a boolean: do the two tables share a customer?"""
    shared = rfm.select(q(rfm_id).cast("string").alias(ID_COL)).join(
        churn.select(F.col(ID_COL).cast("string").alias(ID_COL)), ID_COL, "left_semi"
    )
    return shared.limit(1).agg((F.count(F.lit(1)) > 0).alias("overlap"))


def customer_personas(rfm: DataFrame, label_col: str = "Cluster_ID") -> DataFrame:
    """Adds the persona of each row's cluster; the lookup has one row per cluster."""
    lookup = assign_personas(profile_clusters(rfm, label_col)).select(F.col("Cluster_ID").alias("_c"), "Persona")
    return rfm.join(F.broadcast(lookup), q(label_col) == F.col("_c"), "left").drop("_c")


def fallback_table(churn: DataFrame, probability_col: str = "Churn_Probability") -> DataFrame:
    """Personas by probability thirds and hash-made R/F/M, flagged `synthetic_rfm`, when no customer is shared."""
    pred = churn.select(F.col(ID_COL).cast("string").alias(ID_COL), q(probability_col).alias("Churn_Probability"))
    cuts = exact_quantiles(pred, ["Churn_Probability"], [0.33, 0.66])["Churn_Probability"]
    p, low, high = F.col("Churn_Probability"), F.lit(cuts[0]), F.lit(cuts[1])
    return pred.select(
        ID_COL,
        (F.floor(hash_uniform("R", F.col(ID_COL)) * 99) + 1).cast("bigint").alias("Recency"),
        (F.floor(hash_uniform("F", F.col(ID_COL)) * 19) + 1).cast("bigint").alias("Frequency"),
        (hash_uniform("M", F.col(ID_COL)) * 9500 + 500).alias("Monetary"),
        fallback_cluster(p, low, high).alias("Cluster_ID"),
        fallback_persona(p, low, high).alias("Persona"),
        "Churn_Probability",
        risk_tier(p).alias("Risk_Tier"),
        F.lit(True).alias("synthetic_rfm"),
    )


def build_integrated_customer_table(
    rfm: DataFrame, churn: DataFrame, rfm_id: str = "Customer ID", label_col: str = "Cluster_ID",
    probability_col: str = "Churn_Probability", fallback: bool = True,
) -> DataFrame:
    """Customers with R/F/M, cluster, persona, churn probability and tier; one text key `CustomerID`.

    Labels and probabilities arrive as columns of their tables. Both have one row per customer and are read up
    to three times (overlap, profile, join), so they are kept instead of going back to the transactions each
    time. The customer join is left to AQE.
    """
    rfm, churn = rfm.persist(), churn.select(ID_COL, q(probability_col)).persist()
    if fallback and not id_overlap(rfm, churn, rfm_id).first()["overlap"]:
        return fallback_table(churn, probability_col)
    segments = customer_personas(rfm, label_col).select(
        q(rfm_id).cast("string").alias(ID_COL), "Recency", "Frequency", "Monetary",
        q(label_col).alias("Cluster_ID"), "Persona",
    )
    pred = churn.select(
        F.col(ID_COL).cast("string").alias(ID_COL),
        q(probability_col).alias("Churn_Probability"),
        risk_tier(q(probability_col)).alias("Risk_Tier"),
    )
    return segments.join(pred, ID_COL).withColumn("synthetic_rfm", F.lit(False))


def build_segment_risk_matrix(df: DataFrame) -> DataFrame:
    """Persona x tier counts with totals; always the three tiers and `Total`, zeros filled.

    The cube aggregates first, so only (personas + 1) x (tiers + 1) rows reach the pivot.
    """
    cells = df.cube("Persona", "Risk_Tier").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("Persona").alias("_gp"), F.grouping("Risk_Tier").alias("_gt")
    )
    named = cells.select(
        F.when(F.col("_gp") == 1, TOTAL).otherwise(F.col("Persona")).alias("Persona"),
        F.when(F.col("_gt") == 1, TOTAL).otherwise(F.col("Risk_Tier")).alias("Risk_Tier"), "n",
    )
    columns = [*TIERS, TOTAL]
    wide = named.groupBy("Persona").pivot("Risk_Tier", columns).agg(F.sum("n"))
    return wide.select("Persona", *[F.coalesce(q(c), F.lit(0)).alias(c) for c in columns])


def risk_counts(df: DataFrame) -> DataFrame:
    tier = F.col("Risk_Tier")
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(tier == HIGH).alias("high_risk_customers"),
        F.count_if(tier == MEDIUM).alias("medium_risk_customers"),
        F.count_if(tier == LOW).alias("low_risk_customers"),
    )


def with_actions(df: DataFrame) -> DataFrame:
    return df.withColumn("Recommended_Action", recommended_action(F.col("Persona"), F.col("Risk_Tier")))


def cohort_order() -> list:
    """Riskiest first, then biggest spender, missing values last; the key settles ties."""
    return [
        nan_to_null(F.col("Churn_Probability")).desc_nulls_last(),
        nan_to_null(F.col("Monetary")).desc_nulls_last(),
        F.col(ID_COL),
    ]


def priority_rows(df: DataFrame) -> DataFrame:
    """High and medium risk customers with their action, in no particular order."""
    return with_actions(df).filter(F.col("Risk_Tier").isin(HIGH, MEDIUM))


def identify_priority_action_cohorts(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Priority rows in cohort order. With a limit Spark keeps the top rows per task instead of sorting everything."""
    ordered = priority_rows(df).orderBy(*cohort_order())
    return ordered if limit is None else ordered.limit(limit)


def integrated_report(df: DataFrame, segment_count: int) -> DataFrame:
    """One-row report: counts, the matrix as map of column -> persona -> count, and the top five cohorts."""
    columns = [*TIERS, TOTAL]
    matrix = build_segment_risk_matrix(df).agg(
        F.map_from_entries(F.array(*[
            F.struct(F.lit(c), F.map_from_entries(F.sort_array(F.collect_list(F.struct("Persona", q(c)))))) for c in columns
        ])).alias("risk_matrix")
    )  # one row per persona is collected
    top = identify_priority_action_cohorts(df, 5).select(
        F.struct("Churn_Probability", "Monetary", ID_COL).alias("o"),
        F.struct(ID_COL, "Persona", "Churn_Probability", "Risk_Tier", "Recommended_Action").alias("row"),
    ).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("o.Churn_Probability")).alias("a"), (-F.col("o.Monetary")).alias("b"), F.col("o.CustomerID").alias("c"), "row"
    ))), lambda e: e["row"]).alias("top_priority_cohort_sample"))
    counts = risk_counts(df).withColumn("segment_count", F.lit(segment_count))
    one = F.lit(1).alias("_one")  # three single-row tables side by side
    return (
        counts.select("*", one).join(matrix.select("*", one), "_one").join(top.select("*", one), "_one").drop("_one")
    )

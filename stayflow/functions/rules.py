"""Business rules as plain column expressions: one definition each, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayflow.functions.columns import half_even, nan_to_null

# Labels and cut points that results must carry unchanged.
HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"
TIERS = [HIGH, MEDIUM, LOW]
HIGH_FROM, MEDIUM_FROM = 0.70, 0.30
DECISION_FROM = 0.5
CHAMPIONS, AT_RISK, NEW_LOW, HIBERNATING, LOYAL = (
    "Champions", "At Risk", "New / Low Engagement", "Hibernating", "Loyal / Steady",
)
PERSONAS = [CHAMPIONS, AT_RISK, NEW_LOW, HIBERNATING, LOYAL]
ACTIONS = {
    "vip": "[CRITICAL] Immediate VIP Concierge Call & Personal Executive Discount",
    "loyalty": "[HIGH PRIORITY] Exclusive Loyalty Upgrade & Renewal Offer",
    "winback": "[WIN-BACK] Automated Re-engagement Email & 20% Discount Code",
    "push": "[PUSH NOTIFICATION] App Activity Bonus & Feature Highlight",
    "monitor": "[MONITOR] Standard Engagement & Regular Newsletter",
}
INCREASES, REDUCES = "increases_churn_risk", "reduces_churn_risk"


def risk_tier(p: Column) -> Column:
    """Lower bounds are inclusive; a missing probability (null or NaN) is low risk."""
    p = nan_to_null(p.cast("double"))
    return F.when(p >= HIGH_FROM, HIGH).when(p >= MEDIUM_FROM, MEDIUM).otherwise(LOW)


def persona(recency: Column, frequency: Column, monetary: Column, r_mid: Column, f_mid: Column, m_mid: Column) -> Column:
    """Persona of a cluster from its means, relative to the medians over the clusters."""
    recent, frequent, big = recency <= r_mid, frequency >= f_mid, monetary >= m_mid
    return (
        F.when(recent & frequent & big, CHAMPIONS)
        .when(~recent & (frequent | big), AT_RISK)
        .when(recent & ~frequent & ~big, NEW_LOW)
        .when(~recent, HIBERNATING)
        .otherwise(LOYAL)
    )


def fallback_cluster(p: Column, low_cut: Column, high_cut: Column) -> Column:
    return F.when(p < low_cut, 0).when(p < high_cut, 1).otherwise(2)


def fallback_persona(p: Column, low_cut: Column, high_cut: Column) -> Column:
    return F.when(p < low_cut, CHAMPIONS).when(p < high_cut, LOYAL).otherwise(HIBERNATING)


def recommended_action(persona_col: Column, tier: Column) -> Column:
    """First matching strategy wins."""
    return (
        F.when((persona_col == CHAMPIONS) & (tier == HIGH), ACTIONS["vip"])
        .when(persona_col.isin(CHAMPIONS, LOYAL) & tier.isin(HIGH, MEDIUM), ACTIONS["loyalty"])
        .when((persona_col == AT_RISK) & (tier == HIGH), ACTIONS["winback"])
        .when(tier == HIGH, ACTIONS["push"])
        .otherwise(ACTIONS["monitor"])
    )


def churn_prediction(p: Column) -> Column:
    """1 from a probability of 0.5 on; a missing one (null or NaN) is 0."""
    return F.coalesce(nan_to_null(p.cast("double")) >= DECISION_FROM, F.lit(False)).cast("int")


def confidence(p: Column) -> Column:
    p = nan_to_null(p.cast("double"))
    return F.when(p >= DECISION_FROM, p).otherwise(1 - p)


def impact(v: Column) -> Column:
    return F.when(v > 0, INCREASES).otherwise(REDUCES)


def prediction_columns(p: Column, model_version: str) -> list[Column]:
    """The public prediction record, rounded half-even to four places."""
    return [
        half_even(p, 4).alias("churn_probability"),
        churn_prediction(p).alias("churn_prediction"),
        risk_tier(p).alias("risk_tier"),
        half_even(confidence(p), 4).alias("confidence_score"),
        F.lit(model_version).alias("model_version"),
    ]

"""The two raw inputs derived from the supplied TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.schemas import CHURN_COLUMNS

CUTOFF = "2000-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with returns, zero prices and missing customer ids mixed in by fixed rules.

    Join sides are left to AQE: small dimensions are broadcast only when their measured size allows it.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    buyer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = orders.join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("Invoice"),
            F.col("l_partkey").cast("string").alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
            (
                F.col("o_orderdate").cast("timestamp")
                + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
            ).alias("InvoiceDate"),
            F.when(F.col("l_partkey") % 100 == 0, 0.0)
            .otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
            F.when(F.col("l_orderkey") % 20 != 0, F.col("o_custkey").cast("double")).alias("Customer ID"),
            F.col("n_name").alias("Country"),
        )
    )


def _pick(key, options: list[str], other: str):
    out = F.when(key == 0, options[0])
    for i, name in enumerate(options[1:], start=1):
        out = out.when(key == i, name)
    return out.otherwise(other)


def churn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per customer; features look back from the cut-off day, the label looks ahead of it.

    Orders are read once: history and future come from one aggregate with conditions. Line items are reduced
    to one row per order before they meet the orders, and events to one row per (user, type), so a customer
    that owns a third of all rows is pre-aggregated before any shuffle on the customer key.
    """
    cut = F.lit(CUTOFF).cast("timestamp")
    cut_day = F.lit(CUTOFF).cast("date")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")
    )
    past = F.col("o_orderdate") < cut
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_discount") >= 0.08).alias("coupons"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cashback"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("l_suppkey") % 10).cast("int"))).alias("addr_bits"),
    )
    # Order keys are unique, so per-order sums join one to one and the customer rollup needs no distinct.
    hist = (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(past, F.col("o_orderdate"))).alias("first_d"),
            F.max(F.when(past, F.col("o_orderdate"))).alias("last_d"),
            F.count(F.when(past, 1)).alias("n_ord"),
            F.max((~past).cast("int")).alias("has_future"),
            F.sum(F.when(past, F.col("coupons"))).alias("coupons"),
            F.sum(F.when(past, F.col("cashback"))).alias("cashback"),
            F.bit_or(F.when(past, F.col("addr_bits"))).alias("addr_bits"),
        )
    )
    ev = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(
            F.sum("value").alias("v"),
            F.count("value").alias("n"),
            F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 200), 1).otherwise(0)).alias("bad"),
        )
        .groupBy("user_id")
        .agg(
            (F.try_divide(F.sum("v"), F.sum("n")) / 100).alias("hours"),
            F.count("event_type").alias("devices"),
            F.max("bad").alias("complain"),
        )
    )
    key = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    df = (
        table(spark, sf_dir, "customer")
        .join(hist, key == F.col("o_custkey"), "left")
        .join(ev, key == F.col("user_id"), "left")
    )
    known = F.col("n_ord") > 0
    return df.select(
        key.alias("CustomerID"),
        F.when(F.col("has_future") == 1, 0).otherwise(1).alias("Churn"),
        (F.datediff(cut_day, F.col("first_d").cast("date")).cast("double") / 30).alias("Tenure"),
        _pick(key % 3, ["Phone", "Mobile Phone"], "Computer").alias("PreferredLoginDevice"),
        (F.col("c_nationkey") % 3 + 1).cast("double").alias("CityTier"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 250).cast("double")).alias("WarehouseToHome"),
        _pick(key % 7, ["CC", "COD", "Credit Card", "Cash on Delivery", "Debit Card", "UPI"], "E wallet").alias(
            "PreferredPaymentMode"
        ),
        _pick(key % 2, ["Male"], "Female").alias("Gender"),
        F.col("hours").alias("HourSpendOnApp"),
        F.col("devices").cast("double").alias("NumberOfDeviceRegistered"),
        F.when(key % 13 == 0, "Others").when(seg == "BUILDING", "Mobile").when(seg == "FURNITURE", "Mobile Phone")
        .when(seg == "MACHINERY", "Laptop & Accessory").when(seg == "HOUSEHOLD", "Grocery").otherwise("Fashion")
        .alias("PreferedOrderCat"),
        (key % 5 + 1).cast("double").alias("SatisfactionScore"),
        _pick((key * 31) % 3, ["Single", "Married"], "Divorced").alias("MaritalStatus"),
        F.when(F.col("addr_bits").isNotNull(), F.bit_count("addr_bits").cast("double")).alias("NumberOfAddress"),
        F.col("complain").cast("double").alias("Complain"),
        F.when(key % 11 != 0, (key % 16 + 10).cast("double")).alias("OrderAmountHikeFromlastYear"),
        F.col("coupons").cast("double").alias("CouponUsed"),
        F.when(known, F.col("n_ord").cast("double")).alias("OrderCount"),
        F.datediff(cut_day, F.col("last_d").cast("date")).cast("double").alias("DaySinceLastOrder"),
        (F.col("cashback") / 100).alias("CashbackAmount"),
    ).select(*CHURN_COLUMNS)

"""Column lists, Spark types and the plan-time column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and categories that results must carry unchanged.
RETAIL_COLUMNS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
ID_COL = "CustomerID"
TARGET_COL = "Churn"
NUMERICAL_COLS = [
    "Tenure", "CityTier", "WarehouseToHome", "HourSpendOnApp", "NumberOfDeviceRegistered", "SatisfactionScore",
    "NumberOfAddress", "Complain", "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount", "DaySinceLastOrder",
    "CashbackAmount",
]
DERIVED_COLS = ["OrderVelocity", "CouponUsageRatio", "CashbackPerOrder", "ComplainRiskInteraction", "InactivityRatio"]
CATEGORICAL_COLS = ["PreferredLoginDevice", "PreferredPaymentMode", "Gender", "PreferedOrderCat", "MaritalStatus"]
CHURN_COLUMNS = [
    "CustomerID", "Churn", "Tenure", "PreferredLoginDevice", "CityTier", "WarehouseToHome", "PreferredPaymentMode",
    "Gender", "HourSpendOnApp", "NumberOfDeviceRegistered", "PreferedOrderCat", "SatisfactionScore", "MaritalStatus",
    "NumberOfAddress", "Complain", "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount", "DaySinceLastOrder",
    "CashbackAmount",
]
# What a profile gets for a feature it does not carry.
PROFILE_DEFAULTS = {
    "Tenure": 12.0, "CityTier": 1, "WarehouseToHome": 10.0, "HourSpendOnApp": 3.0, "NumberOfDeviceRegistered": 3,
    "SatisfactionScore": 3, "NumberOfAddress": 1, "Complain": 0, "OrderAmountHikeFromlastYear": 15.0,
    "CouponUsed": 1.0, "OrderCount": 2.0, "DaySinceLastOrder": 5.0, "CashbackAmount": 160.0,
    "PreferredLoginDevice": "Mobile Phone", "PreferredPaymentMode": "Debit Card", "Gender": "Female",
    "PreferedOrderCat": "Laptop & Accessory", "MaritalStatus": "Single",
}

RETAIL_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.StringType()),
    T.StructField("Country", T.StringType()),
])

CHURN_SCHEMA = T.StructType([
    T.StructField(
        c,
        T.StringType() if c == ID_COL or c in CATEGORICAL_COLS else T.IntegerType() if c == TARGET_COL else T.DoubleType(),
    )
    for c in CHURN_COLUMNS
])

PROFILE_SCHEMA = T.StructType(
    [T.StructField(ID_COL, T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERICAL_COLS]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLS]
)


def require_columns(df: DataFrame, expected: Iterable[str], what: str = "input") -> DataFrame:
    """Fail at plan time, naming every missing column; extra columns are allowed."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df

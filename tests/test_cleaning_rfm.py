import datetime as dt

import pytest
from pyspark.sql import functions as F

from stayflow.functions.columns import half_even, id_string
from stayflow.functions.rules import churn_prediction, confidence
from stayflow.operators.cleaning import clean_churn_data, clean_retail_data, clean_retail_observed, retail_retention
from stayflow.operators.rfm import build_rfm_table
from stayflow.schemas import CHURN_SCHEMA, RETAIL_COLUMNS
from stayflow.sources.readers import load_retail_data

ROWS = [
    ("i1", "s", "d", 2.0, "2011-12-08 13:00:00", 5.0, "13085.0", "UK"),
    ("i1", "s", "d", 1.0, "2011-12-08 13:00:00", 1.5, "13085", "UK"),
    ("i2", "s", "d", -3.0, "2011-12-08 13:00:00", 5.0, "13085", "UK"),
    ("i3", "s", "d", 3.0, "2011-12-08 13:00:00", 0.0, "13085", "UK"),
    ("i4", "s", "d", float("nan"), "2011-12-08 13:00:00", 5.0, "13085", "UK"),
    ("i5", "s", "d", 3.0, "2011-12-08 13:00:00", 5.0, None, "UK"),
    ("i6", "s", "d", 3.0, "2011-12-01 00:00:00", 5.0, "7", "UK"),
]
SCHEMA = "Invoice string, StockCode string, Description string, Quantity double, InvoiceDate string, Price double, `Customer ID` string, Country string"


def retail(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_cleaning_keeps_valid_sales_only(spark):
    rows = clean_retail_data(retail(spark)).collect()
    assert sorted((r["Customer ID"], r["TotalAmount"]) for r in rows) == [("13085", 1.5), ("13085", 10.0), ("7", 15.0)]
    assert all(isinstance(r["InvoiceDate"], dt.datetime) for r in rows)


def test_nan_customer_is_missing(spark):
    rows = spark.createDataFrame([("NaN",), ("5",)], "`Customer ID` string").select(
        "Customer ID", F.lit(1.0).alias("Quantity"), F.lit(1.0).alias("Price"), F.lit("2011-01-01").alias("InvoiceDate"))
    assert [r[0] for r in clean_retail_data(rows).select("Customer ID").collect()] == ["5"]


def test_bad_date_raises_unless_lenient(spark):
    bad = retail(spark).withColumn("InvoiceDate", F.lit("never"))
    with pytest.raises(Exception):
        clean_retail_data(bad).collect()
    assert clean_retail_data(bad, lenient_dates=True).filter("InvoiceDate IS NULL").count() == 3


def test_retention(spark):
    row = retail_retention(retail(spark)).first()
    assert (row["initial_rows"], row["final_rows"]) == (7, 3)
    cleaned, before, after = clean_retail_observed(retail(spark))
    cleaned.collect()
    assert before.get["rows"] == 7 and after.get["rows"] == 3


def test_churn_recodes(spark):
    row = [None] * len(CHURN_SCHEMA)
    names = CHURN_SCHEMA.names
    row[names.index("CustomerID")] = "50001.0"
    row[names.index("Churn")] = 1
    for c, v in (("PreferredLoginDevice", "Phone"), ("PreferredPaymentMode", "COD"), ("PreferedOrderCat", "Mobile")):
        row[names.index(c)] = v
    out = clean_churn_data(spark.createDataFrame([tuple(row)], CHURN_SCHEMA)).first()
    assert out["CustomerID"] == "50001"
    assert (out["PreferredLoginDevice"], out["PreferredPaymentMode"], out["PreferedOrderCat"]) == (
        "Mobile Phone", "Cash on Delivery", "Mobile Phone")
    assert out["Gender"] is None


def test_id_and_half_even(spark):
    row = spark.range(1).select(
        id_string(F.lit("13085.0")).alias("a"), id_string(F.lit(13085.0), "double").alias("b"), id_string(F.lit(9007199254740993), "bigint").alias("c"),
        id_string(F.lit("9007199254740993")).alias("d"), id_string(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(row) == ("13085", "13085", "9007199254740993", "9007199254740993", None)
    values = [2.5, 0.00125, 0.12345, 0.45675, 0.5, 1.5, 0.00005, 0.00015, 1e15 + 0.5, 1e300, 0.0] + [i / 80000 for i in range(1, 400, 2)]
    values += [-v for v in values]
    for digits in (0, 2, 4):
        got = spark.createDataFrame([(v,) for v in values], "v double").select(half_even(F.col("v"), digits)).collect()
        assert [r[0] for r in got] == [round(v, digits) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(half_even(F.col("v"), 4)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0] and odd[2][0] == float("inf")


def test_ids_beyond_doubles_stay_apart(spark):
    rows = retail(spark)
    raw = rows.withColumn("Customer ID", F.lit(9007199254740992)).unionByName(rows.withColumn("Customer ID", F.lit(9007199254740993)))
    ids = {r[0] for r in build_rfm_table(clean_retail_data(raw)).select("Customer ID").collect()}
    assert ids == {"9007199254740992", "9007199254740993"}


def test_missing_probability_is_no_churn(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in df.select(churn_prediction(F.col("p"))).collect()] == [1, 0, 0, 0]
    assert [r[0] for r in df.select(confidence(F.col("p"))).collect()][2:] == [None, None]


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    folder = tmp_path / "mixed"
    swapped = [{"Quantity": "Price", "Price": "Quantity"}.get(c, c) for c in RETAIL_COLUMNS]
    for order in (RETAIL_COLUMNS, swapped):
        retail(spark).select(*order).coalesce(1).write.mode("append").option("header", True).csv(str(folder))
    with pytest.raises(Exception, match="(?i)header|column"):
        load_retail_data(spark, str(folder), "csv").agg(F.sum("Price")).collect()


def test_missing_column_is_named(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    retail(spark).drop("Price").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="Price"):
        load_retail_data(spark, path)
    with pytest.raises(Exception):
        load_retail_data(spark, str(tmp_path / "absent.csv"))
    ok = str(tmp_path / "ok.csv")
    retail(spark).select(*reversed(RETAIL_COLUMNS)).write.option("header", True).csv(ok)
    assert load_retail_data(spark, ok).agg(F.sum("Price")).first()[0] == 26.5


def transactions(spark, rows):
    return spark.createDataFrame(rows, "`Customer ID` string, Invoice string, d string, TotalAmount double").withColumn(
        "InvoiceDate", F.to_timestamp("d"))


@pytest.mark.parametrize("snapshot,expected", [
    ("2011-12-10 12:50:00", 1), ("2011-12-08 12:50:00", -1), ("2011-12-08 13:00:00", 0)])
def test_recency_counts_whole_days(spark, snapshot, expected):
    df = transactions(spark, [("1", "a", "2011-12-08 13:00:00", 3.0)])
    assert build_rfm_table(df, snapshot_date=snapshot).first()["Recency"] == expected


def test_rfm_values(spark):
    df = transactions(spark, [
        ("1", "a", "2024-01-01 10:00:00", 3.0), ("1", "a", "2024-01-01 10:00:00", 4.0), ("1", "b", "2024-01-05 10:00:00", 1.0),
        ("2", "c", "2024-01-10 10:00:00", 2.0), ("3", "d", "2024-01-02 10:00:00", 0.0), (None, "e", "2024-02-02 10:00:00", 5.0),
        ("4", None, "2024-01-03 10:00:00", 5.0)])
    out = {r["Customer ID"]: (r["Recency"], r["Frequency"], r["Monetary"]) for r in build_rfm_table(df).collect()}
    assert out == {"1": (6, 2, 8.0), "2": (1, 1, 2.0), "4": (8, 0, 5.0)}
    later = {r["Customer ID"]: r["Recency"] for r in build_rfm_table(df, snapshot_date="2024-02-09 10:00:00").collect()}
    assert all(later[k] == out[k][0] + 29 for k in out)


def test_rfm_scan_is_pruned_and_shared(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    clean_retail_data(retail(spark)).write.parquet(path)
    out = build_rfm_table(spark.read.parquet(path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert "Description" not in final

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stayflow.functions.rules import TIERS, recommended_action, risk_tier
from stayflow.operators import integration as I
from stayflow.operators import scoring
from stayflow.operators.classifiers import train_random_forest
from stayflow.operators.churn_features import prepare_churn_features
from stayflow.plans import jobs
from stayflow.plans.catalog import churn
from stayflow.schemas import PROFILE_DEFAULTS
from stayflow.sources.readers import load_report
from stayflow.sources.tables import churn_raw, retail_raw
from stayflow.streaming.scoring import start_scoring
from pyspark.ml import PipelineModel


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(0.99,), (0.70,), (0.6999,), (0.30,), (0.2999,), (None,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(risk_tier(F.col("p"))).collect()]
    high, medium, low = TIERS
    assert got == [high, high, medium, medium, low, low, low]


def tables(spark, ids=("1", "2", "3", "4", "5")):
    rfm = spark.createDataFrame(
        [(i, r, f, float(m), c) for i, (r, f, m, c) in zip(["1", "2", "3", "4", "5"], [
            (5, 20, 5000, 0), (7, 22, 5200, 0), (300, 1, 50, 1), (6, 21, 4800, 0), (310, 2, 60, 1)])],
        "`Customer ID` string, Recency int, Frequency int, Monetary double, Cluster_ID int")
    pred = spark.createDataFrame(list(zip(ids, [0.12, 0.41, 0.77, 0.02, 0.93])), "CustomerID string, Churn_Probability double")
    return rfm, pred


def test_integration_by_hand(spark):
    table = I.build_integrated_customer_table(*tables(spark))
    assert table.count() == 5 and table.filter("synthetic_rfm").count() == 0
    assert I.risk_counts(table).first() == (5, 2, 1, 2)
    matrix = {r["Persona"]: r for r in I.build_segment_risk_matrix(table).collect()}
    assert matrix["Total"]["Total"] == 5 and matrix["Champions"]["Low Risk"] == 2 and matrix["Hibernating"]["High Risk"] == 2
    assert matrix["Champions"]["High Risk"] == 0
    cohorts = I.identify_priority_action_cohorts(table).collect()
    assert [r["CustomerID"] for r in cohorts] == ["5", "3", "2"]
    assert cohorts[0]["Recommended_Action"].startswith("[PUSH") and cohorts[2]["Recommended_Action"].startswith("[HIGH PRIORITY]")
    assert [r["CustomerID"] for r in I.identify_priority_action_cohorts(table, 2).collect()] == ["5", "3"]


def test_fallback_is_flagged_and_repeatable(spark):
    rfm, pred = tables(spark, ("91", "92", "93", "94", "95"))
    assert I.id_overlap(rfm, pred).first()["overlap"] is False
    a = I.build_integrated_customer_table(rfm, pred)
    rows = {r["CustomerID"]: r for r in a.collect()}
    assert all(r["synthetic_rfm"] for r in rows.values())
    assert [rows[c]["Persona"] for c in ("94", "91", "92", "93", "95")] == [
        "Champions", "Champions", "Loyal / Steady", "Hibernating", "Hibernating"]
    assert all(1 <= r["Recency"] < 100 and 1 <= r["Frequency"] < 20 and 500 <= r["Monetary"] < 10000 for r in rows.values())
    assert rows == {r["CustomerID"]: r for r in I.build_integrated_customer_table(rfm, pred.repartition(3)).collect()}


def test_actions(spark):
    cases = [("Champions", "High Risk", "[CRITICAL]"), ("Champions", "Medium Risk", "[HIGH PRIORITY]"), ("Loyal / Steady", "High Risk", "[HIGH PRIORITY]"),
             ("At Risk", "High Risk", "[WIN-BACK]"), ("Hibernating", "High Risk", "[PUSH"), ("At Risk", "Medium Risk", "[MONITOR]"), ("Champions", "Low Risk", "[MONITOR]")]
    df = spark.createDataFrame(cases, "p string, t string, want string")
    for r in df.withColumn("got", recommended_action(F.col("p"), F.col("t"))).collect():
        assert r["got"].startswith(r["want"])


def test_missing_values_sort_last(spark):
    rows = [("a", "Champions", float("nan"), 1.0), ("b", "Champions", 0.8, 1.0), ("c", "Champions", 0.8, float("nan")), ("d", "Champions", 0.9, None)]
    df = spark.createDataFrame(rows, "CustomerID string, Persona string, Churn_Probability double, Monetary double").withColumn("Risk_Tier", F.lit("High Risk"))
    assert [r["CustomerID"] for r in I.identify_priority_action_cohorts(df).collect()] == ["d", "b", "c", "a"]


def test_topk_plan_takes_ordered(spark):
    table = I.build_integrated_customer_table(*tables(spark))
    plan = I.identify_priority_action_cohorts(table, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.fixture(scope="module")
def forest(spark):
    rows = churn(spark, SF_SMALL).persist()
    features, _, stage = prepare_churn_features(rows)
    return PipelineModel(stages=[stage, train_random_forest(features, trees=5, depth=3)])


def test_stream_equals_batch_and_defaults_apply(spark, forest, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [r.asDict() for r in churn(spark, SF_SMALL).drop("Churn").collect()]
    for part in range(3):
        with open(folder / f"{part}.json", "w") as f:
            for i, r in enumerate(rows[part::3]):
                # absent fields, not nulls; every fifth record carries only its id and tenure
                kept = {k: v for k, v in r.items() if v is not None and (i % 5 or k in ("CustomerID", "Tenure"))}
                f.write(json.dumps(kept) + "\n")
    query = start_scoring(spark, forest, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), "forest")
    assert query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("customer_id").collect()
    from stayflow.schemas import PROFILE_SCHEMA
    batch = scoring.predict_churn_batch(forest, spark.read.schema(PROFILE_SCHEMA).json(str(folder)), "forest").orderBy("customer_id").collect()
    assert streamed == batch and len(batch) == len(rows)
    for r in batch:
        assert r["churn_prediction"] == int(r["churn_probability"] >= 0.5) or abs(r["churn_probability"] - 0.5) < 1e-4
        assert 0.5 <= r["confidence_score"] <= 1 and r["model_version"] == "forest"


def test_request_without_features_takes_all_defaults(spark, forest):
    one = spark.range(1).select(F.lit(None).cast("string").alias("CustomerID"))
    full = one
    for name, value in PROFILE_DEFAULTS.items():
        full = full.withColumn(name, F.lit(value))
    a, b = (scoring.predict_churn_batch(forest, d, "v").first() for d in (one, full))
    assert a == b and a["customer_id"] == "N/A"


def test_lookups(spark):
    table = spark.createDataFrame([("1", "x"), ("2", "y")], "customer_id string, v string")
    wanted = spark.createDataFrame([(1,), (9,), (9,)], "customer_id bigint")
    assert [r["v"] for r in scoring.find_customers(table, wanted).collect()] == ["x"]
    assert [r[0] for r in scoring.unknown_customers(wanted, table).collect()] == ["9"]
    ids = scoring.batch_ids(spark.createDataFrame([(1, None), (2, "c")], "seq bigint, CustomerID string"), "seq")
    assert [r["customer_id"] for r in ids.collect()] == ["BATCH_0001", "c"]


def test_report_job_writes_all_three_files(spark, forest, tmp_path):
    report = jobs.generate_integrated_risk_report(
        retail_raw(spark, SF_SMALL), churn_raw(spark, SF_SMALL), forest, str(tmp_path), k_range=range(2, 4), restarts=1).first()
    stored = load_report(spark, str(tmp_path / "integrated_risk_report.json")).first()
    assert stored["total_customers"] == report["total_customers"] > 0
    assert report["high_risk_customers"] + report["medium_risk_customers"] + report["low_risk_customers"] == report["total_customers"]
    assert report["risk_matrix"]["Total"]["Total"] == report["total_customers"]
    top = report["top_priority_cohort_sample"]
    assert len(top) <= 5 and [t["Churn_Probability"] for t in top] == sorted((t["Churn_Probability"] for t in top), reverse=True)
    matrix = spark.read.option("header", True).csv(str(tmp_path / "segment_risk_matrix.csv"))
    assert matrix.columns == ["Persona", *TIERS, "Total"]
    assert spark.read.option("header", True).csv(str(tmp_path / "priority_action_cohorts.csv")).count() <= 50


def test_segmentation_job_writes_personas(spark, tmp_path):
    out = jobs.segmentation_job(retail_raw(spark, SF_SMALL), str(tmp_path), k_range=range(2, 4), restarts=1)
    assert sum(r["Pct_of_Base"] for r in out.collect()) == pytest.approx(100, abs=0.05)
    assert spark.read.option("header", True).csv(str(tmp_path / "customer_segments_with_personas.csv")).count() == out.count()


def test_models_score_after_rows_were_observed(spark, tmp_path):
    from stayflow.operators.cleaning import clean_retail_observed
    from stayflow.operators.classifiers import train_logistic_regression
    from stayflow.operators.tuning import tune_random_forest

    observed, before, _ = clean_retail_observed(retail_raw(spark, SF_SMALL))
    assert observed.count() <= before.get["rows"]
    rows = churn(spark, SF_SMALL).persist()
    features, _, stage = prepare_churn_features(rows)
    space = {"n_estimators": [3], "max_depth": [3], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    tuned = tune_random_forest(features.select("CustomerID", "Churn", "features"), n_trials=1, space=space)[0]
    for model in (train_logistic_regression(features), train_random_forest(features, trees=3, depth=3), tuned):
        pipeline = PipelineModel(stages=[stage, model])
        batch = scoring.predict_churn_batch(pipeline, rows, "m")
        assert batch.count() == rows.count()
        folder = tmp_path / type(model).__name__ / model.uid
        rows.drop("Churn").write.json(str(folder / "in"))
        start_scoring(spark, pipeline, str(folder / "in"), str(folder / "out"), str(folder / "checkpoint"), "m").awaitTermination()
        assert spark.read.parquet(str(folder / "out")).exceptAll(batch).isEmpty()


def test_batch_ids_follow_positions(spark):
    rows = churn(spark, SF_SMALL).limit(4).withColumn("CustomerID", F.when(F.col("CustomerID").cast("int") % 2 == 0, F.col("CustomerID"))).persist()
    features, _, stage = prepare_churn_features(churn(spark, SF_SMALL).persist())
    pipeline = PipelineModel(stages=[stage, train_random_forest(features, trees=2, depth=2)])
    placed = rows.withColumn("seq", F.row_number().over(Window.orderBy("Tenure", "CashbackAmount")))
    got = {r["customer_id"] for r in scoring.predict_churn_batch(pipeline, placed, "m", seq_col="seq").collect()}
    want = {r["CustomerID"] or f"BATCH_{r['seq']:04d}" for r in placed.collect()}
    assert got == want and len(got) == 4

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stayflow.functions.columns import hash_uniform
from stayflow.functions.rules import churn_prediction
from stayflow.operators import attribution as A
from stayflow.operators import churn_features
from stayflow.operators import classifiers as C
from stayflow.operators.churn_features import prepare_churn_features
from stayflow.operators.metrics import (
    AveragePrecisionEvaluator, calculate_scale_pos_weight, class_weights, confusion, evaluate_model_performance, ranking_metrics,
)
from stayflow.operators.oversampling import smote_balance
from stayflow.operators.splitting import assign_folds, assign_split, holdout_sizes, split_churn_data
from stayflow.operators import splitting
from stayflow.operators.tuning import FOREST_SPACE, GBT_SPACE, draw_params
from stayflow.plans import jobs
from stayflow.plans.catalog import churn
from stayflow.schemas import DERIVED_COLS, NUMERICAL_COLS
from stayflow.sources.readers import load_preferred_model, load_report, load_splits


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Profiles whose label follows Complain, Tenure and SatisfactionScore."""
    n = 1500
    u = {c: hash_uniform(c, F.col("id")) for c in ("t", "c", "s", "y", "o", "k", "d", "w")}
    pick = lambda name, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u[name] * len(values)) + 1).cast("int"))
    df = spark.range(n).select(
        F.col("id").cast("string").alias("CustomerID"),
        (F.floor(u["t"] * 30)).cast("double").alias("Tenure"), pick("d", [1.0, 2.0, 3.0]).alias("CityTier"),
        (u["w"] * 30).alias("WarehouseToHome"), (u["o"] * 4).alias("HourSpendOnApp"), pick("o", [1.0, 2.0, 3.0]).alias("NumberOfDeviceRegistered"),
        pick("s", [1.0, 2.0, 3.0, 4.0, 5.0]).alias("SatisfactionScore"), pick("k", [1.0, 2.0]).alias("NumberOfAddress"),
        (u["c"] < 0.3).cast("double").alias("Complain"), (u["k"] * 15 + 10).alias("OrderAmountHikeFromlastYear"),
        pick("w", [0.0, 1.0, 2.0]).alias("CouponUsed"), F.when(u["d"] > 0.05, F.floor(u["o"] * 9).cast("double")).alias("OrderCount"),
        (u["k"] * 20).alias("DaySinceLastOrder"), (u["w"] * 200).alias("CashbackAmount"),
        pick("o", ["Computer", "Mobile Phone"]).alias("PreferredLoginDevice"), pick("k", ["UPI", "Debit Card"]).alias("PreferredPaymentMode"),
        pick("d", ["Male", "Female"]).alias("Gender"), pick("w", ["Fashion", "Grocery"]).alias("PreferedOrderCat"),
        pick("k", ["Single", "Married"]).alias("MaritalStatus"),
        u["y"].alias("_u"),
    )
    z = 6 * F.col("Complain") - 0.4 * F.col("Tenure") + (3 - F.col("SatisfactionScore")) + 2
    df = df.withColumn("Churn", (F.col("_u") < 1 / (1 + F.exp(-2 * z))).cast("int")).drop("_u")
    # written out, because every test clears the cache
    folder = str(tmp_path_factory.mktemp("planted"))
    split_churn_data(df, save_outputs=True, output_dir=folder)
    return load_splits(spark, folder)


def test_metrics_by_hand(spark):
    # 0.6 ties a positive with a negative: positives win 3 + 2.5 + 1 + 3 of 12 pairs
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1, 0, 1], [1, 1, 1, 0, 0, 1, 1], [0.8, 0.6, 0.6, 0.2, 0.3, 0.55, 0.95])), "Churn int, churn_prediction int, p double")
    out = evaluate_model_performance("m", df)
    assert out == {
        "model_name": "m", "roc_auc": pytest.approx(9.5 / 12), "pr_auc": pytest.approx((1 + 1 + 3 / 4 + 4 / 6) / 4),
        "f1_score": pytest.approx(6 / 9), "precision": pytest.approx(3 / 5), "recall": pytest.approx(3 / 4),
    }
    row = confusion(df).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 2, 1, 3)
    assert calculate_scale_pos_weight(df) == 0.75
    none = confusion(df.withColumn("churn_prediction", F.lit(0))).first()
    assert (none["precision"], none["recall"], none["f1_score"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows_per_range", [50_000, 13])
def test_ranking_metrics_with_ties(spark, monkeypatch, rows_per_range):
    from stayflow.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "Churn int, p double")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, tp_before = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp, n = (y[s >= t] == 1).sum(), (s >= t).sum()
        ap += (tp - tp_before) / len(pos) * tp / n
        tp_before = tp
    row = ranking_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(ap)


def test_single_class_gives_null_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "Churn int, p double")
    assert ranking_metrics(df).first()["roc_auc"] is None
    assert calculate_scale_pos_weight(df.withColumn("Churn", F.lit(0))) is None


def test_split_sizes_and_rates(spark, monkeypatch, tmp_path):
    rows = churn(spark, SF_SMALL).persist()
    n = rows.count()
    for per_prefix in (20_000, 5):
        monkeypatch.setattr(splitting, "ROWS_PER_PREFIX", per_prefix)
        train, test = split_churn_data(rows, save_outputs=True, output_dir=str(tmp_path / str(per_prefix)))
        a, b = load_splits(spark, str(tmp_path / str(per_prefix)))
        assert b.count() == math.ceil(0.2 * n) and a.count() + b.count() == n
        assert a.join(b, "CustomerID", "left_semi").count() == 0
        folds = assign_folds(rows).groupBy("Churn", "fold").count().collect()
        for label in (0, 1):
            sizes = [r["count"] for r in folds if r["Churn"] == label]
            assert max(sizes) - min(sizes) <= 1
    first = {r[0] for r in assign_split(rows).filter("split = 'test'").select("CustomerID").collect()}
    again = {r[0] for r in assign_split(rows.repartition(7)).filter("split = 'test'").select("CustomerID").collect()}
    assert first == again
    assert holdout_sizes({0: 7, 1: 3}, 0.25) == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        split_churn_data(rows.drop("Churn"))


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "Churn int")
    assert {r["Churn"]: r["weight"] for r in class_weights(df).collect()} == {0: pytest.approx(8 / 12), 1: 2.0}


def test_baselines_pass_gates_and_save_one_pipeline(spark, planted, tmp_path):
    train, test = planted
    metrics, models = jobs.train_and_evaluate_baselines(train, test, str(tmp_path))
    rows = {r["model_name"]: r for r in metrics.collect()}
    assert rows["Logistic Regression"]["roc_auc"] > 0.9 and rows["Random Forest"]["roc_auc"] > 0.9
    name, loaded = load_preferred_model(spark, str(tmp_path))
    assert name == "baseline_random_forest"
    a = loaded.transform(test).orderBy("CustomerID").select("probability").limit(5).collect()
    assert a == models[name].transform(test).orderBy("CustomerID").select("probability").limit(5).collect()
    with pytest.raises(FileNotFoundError):
        load_preferred_model(spark, str(tmp_path / "none"))


def test_baselines_learn_the_features_once(spark, planted, monkeypatch):
    train, test = planted
    alone = prepare_churn_features(train)[2]
    asked, find = [], churn_features.exact_medians
    monkeypatch.setattr(churn_features, "exact_medians", lambda df, cols: asked.append(cols) or find(df, cols))
    _, models = jobs.train_and_evaluate_baselines(train, test, trees=2, depth=2)
    assert asked == [NUMERICAL_COLS, DERIVED_COLS]
    features = models["baseline_random_forest"].stages[0]
    assert features.learned == alone.learned and not features.getOrDefault(features.scaleFeatures)
    assert features.transform(test).orderBy("CustomerID").collect() == alone.transform(test).orderBy("CustomerID").collect()


def test_evaluation_scores_every_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def model(i):
        seen.add(1)
        return (i * 7 % 100) / 100

    rows = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("Churn"), model("id").alias("p"))
    got = evaluate_model_performance("m", rows)
    assert seen.value == 400
    plain = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("Churn"), ((F.col("id") * 7 % 100) / 100).alias("p"))
    want, ranks = confusion(plain.withColumn("c", churn_prediction(F.col("p"))), "Churn", "c").first(), ranking_metrics(plain).first()
    assert [got[m] for m in ("precision", "recall", "f1_score")] == [want[m] for m in ("precision", "recall", "f1_score")]
    assert (got["roc_auc"], got["pr_auc"]) == pytest.approx((ranks["roc_auc"], ranks["pr_auc"]), rel=1e-12)


def test_logistic_regression_solves_the_penalised_problem(spark, planted):
    train, _ = planted
    rows, _, model = prepare_churn_features(train, scale_features=True)
    fitted = C.train_logistic_regression(rows)
    data = rows.select("Churn", "features").toPandas()
    x, y = np.stack([v.toArray() for v in data["features"]]), data["Churn"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    beta, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    grad = x.T @ (w * (p - y)) + beta  # C = 1
    assert np.abs(grad).max() / len(y) < 1e-3


def test_boosting_and_attribution_rank_the_planted_features(spark, planted, tmp_path):
    train, test = planted
    metrics, models = jobs.train_and_evaluate_gbdt(train, test, rounds=40, depth=4, presets=("hist",), out_dir=str(tmp_path))
    row = metrics.first()
    assert row["roc_auc"] > 0.88 and row["pr_auc"] > 0.82 and row["f1_score"] > 0.78
    pipeline = models["gbdt_hist_gradient_boosting"]
    importance, explained = jobs.explain_all(pipeline, test, 3)
    top = [r["feature"] for r in importance.limit(4).collect()]
    assert "Tenure" in top and ("Complain" in top or "ComplainRiskInteraction" in top)
    rows = explained.collect()
    assert len(rows) == test.count()
    for r in rows[:20]:
        drivers = [d["shap_value"] for d in r["top_risk_drivers"]]
        assert len(drivers) <= 3 and drivers == sorted(drivers, reverse=True) and all(d > 0 for d in drivers)
        assert all(d["impact"] == "reduces_churn_risk" and d["shap_value"] < 0 for d in r["top_protective_factors"])
    jobs.generate_shap_explanations(pipeline, test, str(tmp_path))
    report = load_report(spark, str(tmp_path / "shap_explainability_report.json")).first()
    assert [f["feature"] for f in report["global_top_features"]][:2] == top[:2]
    assert load_report(spark, str(tmp_path / "customer_explanations.parquet")).count() == len(rows)
    z, _ = jobs.explain_all(pipeline, test, 3, method="zscore")
    assert z.count() == 15


def subset_shapley(leaves, x):
    """Definition: average over all orders of the conditional expectation of the trees."""
    d = len(x)

    def value(subset):
        total = 0.0
        for m, g in leaves.items():
            for v, f, lo, hi, z in zip(g["value"], g["feature"], g["lo"], g["hi"], g["share"]):
                p = 1.0
                for j in range(m):
                    p *= float(lo[j] < x[f[j]] <= hi[j]) if f[j] in subset else z[j]
                total += v * p
        return total

    phi = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            for s in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi[i] += w * (value(set(s) | {i}) - value(set(s)))
    return phi


def test_tree_values_equal_the_definition(spark, planted):
    train, _ = planted
    rows, _, _ = prepare_churn_features(train)
    small = rows.select("CustomerID", "Churn", F.array("Tenure", "Complain", "SatisfactionScore", "CashbackAmount", "OrderCount").alias("x"))
    from pyspark.ml.functions import array_to_vector
    small = small.withColumn("features", array_to_vector("x")).drop("x").persist()
    for model in (C.train_random_forest(small, trees=3, depth=5), C.train_boosted_trees(small, "Churn", None, 3, depth=4)):
        leaves = A.ensemble_leaves(model)
        scored = C.with_probability(model, small)
        out = A.tree_attributions(scored.limit(6), model).toPandas()
        for x, phi, p in zip(out["features"], out["attribution"], out["p"]):
            assert np.allclose(phi, subset_shapley(leaves, np.array(x)), atol=1e-9)
            total = A.base_value(leaves) + sum(phi)
            assert p == pytest.approx(1 / (1 + math.exp(-2 * total)) if "GBT" in type(model).__name__ else total, abs=1e-9)


def test_zscore_single_row_uses_training_moments(spark):
    df = spark.createDataFrame([("1", 1.0, 5.0), ("2", 3.0, 5.0)], "CustomerID string, a double, b double")
    means, stds = A.feature_moments(df, ["a", "b"])
    assert (means, stds) == ([2.0, 5.0], [pytest.approx(math.sqrt(2)), 1.0])
    row = A.zscore_attributions(df.filter("CustomerID = '2'"), ["a", "b"], means, stds).first()
    assert row["attribution"] == [pytest.approx(0.5 / math.sqrt(2)), 0.0]


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), int(i % 6 == 0), [float(v) for v in rng.normal(0, 1, 3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "CustomerID string, Churn int, features array<double>")
    out = smote_balance(df).toPandas()
    assert out["Churn"].value_counts().to_dict() == {0: 100, 1: 100}
    assert (~out["synthetic"]).sum() == 120 and out["CustomerID"].is_unique
    minority = np.array([r[2] for r in rows if r[1] == 1])
    for v in out[out["synthetic"]]["features"]:
        v = v.toArray()
        gaps = [abs(np.linalg.norm(a - v) + np.linalg.norm(v - b) - np.linalg.norm(a - b)) for a in minority for b in minority]
        assert min(gaps) < 1e-9
    again = smote_balance(df.repartition(5)).toPandas()
    assert sorted(again["CustomerID"]) == sorted(out["CustomerID"])
    assert sorted(map(str, again["features"])) == sorted(map(str, out["features"]))


def test_oversampled_training_keeps_the_test_rows(spark, planted):
    train, test = planted
    metrics, _ = jobs.train_and_evaluate_gbdt(train, test, use_smote=True, rounds=3, depth=3, presets=("xgb",))
    assert metrics.first()["roc_auc"] > 0.85


def test_perceptron(spark, planted):
    row = jobs.train_and_evaluate_tabnet(*planted)[0].first()
    assert row["roc_auc"] > 0.88 and row["pr_auc"] > 0.82 and row["f1_score"] > 0.78


def test_draws_and_evaluator(spark):
    draws = draw_params(GBT_SPACE, 20, 42)
    assert len(draws) == 20 and draws == draw_params(GBT_SPACE, 20, 42)
    assert len(draw_params(FOREST_SPACE, 10_000, 1)) == 162
    assert len({str(d) for d in draws}) == 20 and all(set(d) == set(GBT_SPACE) for d in draws)
    assert len(draw_params(FOREST_SPACE, 3, 1)) == 3
    assert AveragePrecisionEvaluator().isLargerBetter()


def test_tuning_names_a_champion(spark, planted, tmp_path):
    train, test = planted
    metrics, info = jobs.tune_and_evaluate_all(
        train, test, 1, str(tmp_path),
        {"learning_rate": [0.1], "max_iter": [4], "max_depth": [3], "min_samples_leaf": [10], "l2_regularization": [1.0]},
        {"n_estimators": [5], "max_depth": [4], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]},
    )
    rows = metrics.collect()
    assert [r["champion"] for r in rows].count(True) == 1
    assert max(rows, key=lambda r: r["cv_pr_auc"])["champion"]
    report = load_report(spark, str(tmp_path / "hyperparameter_tuning_results.json")).first()
    assert report["champion_model"] == info["champion_model"]
    assert report["best_params"]["RandomForest"]["n_estimators"] == "5"
    assert load_preferred_model(spark, str(tmp_path))[0] == "tuned_champion_model"

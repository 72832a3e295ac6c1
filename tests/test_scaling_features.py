import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stayflow.operators.churn_features import ChurnFeatureEngineer, ChurnFeatureModel, prepare_churn_features
from stayflow.operators.ordered import global_positions, running_totals
from stayflow.operators import ordered
from stayflow.operators.quantiles import exact_medians, exact_quantiles
from stayflow.operators.scaling import RFMScaler, fit_lambdas, yeo_johnson
from stayflow.plans.catalog import churn
from stayflow.schemas import CATEGORICAL_COLS


def lognormal(spark, n=4000):
    u = [F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(s))), 1, 13), 16, 10).cast("double") / 16.0**13 for s in "abcd"]
    z1 = F.sqrt(-2 * F.ln(u[0] + 1e-12)) * F.cos(2 * math.pi * u[1])
    z2 = F.sqrt(-2 * F.ln(u[2] + 1e-12)) * F.cos(2 * math.pi * u[3])
    return spark.range(n).select("id", F.exp(5 + 0.5 * z1).alias("a"), F.exp(z2).alias("b"), (z1 * 3).alias("c")).persist()


def likelihood(x, lam):
    y = np.where(x >= 0, np.expm1(lam * np.log1p(np.abs(x))) / lam, 0) if (x >= 0).all() else np.where(
        x >= 0, np.expm1(lam * np.log1p(np.abs(x))) / lam, -np.expm1((2 - lam) * np.log1p(np.abs(x))) / (2 - lam))
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_lambdas_maximise_the_likelihood(spark):
    df = lognormal(spark)
    lams = fit_lambdas(df, ["a", "b", "c"])
    data = df.toPandas()
    for c, lam in lams.items():
        x = data[c].to_numpy()
        top = likelihood(x, lam)
        assert all(top >= likelihood(x, lam + d) for d in (-1e-3, 1e-3, -1e-4, 1e-4))
    assert abs(lams["a"]) < 0.1 and -1.1 < lams["b"] < -0.7 and abs(lams["c"] - 1) < 0.1


def test_scaler_centres_and_round_trips(spark, tmp_path):
    df = lognormal(spark)
    model = RFMScaler(inputCols=["a", "b"], outputCols=["x", "y"]).fit(df)
    row = model.transform(df).agg(F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
    assert np.allclose(row, [0, 0, 1, 1], atol=1e-6)
    model.save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert again.transform(df).select("x", "features").first() == model.transform(df).select("x", "features").first()


def test_yeo_johnson_edges(spark):
    row = spark.range(1).select(*[yeo_johnson(F.lit(x), lam).alias(f"v{i}") for i, (x, lam) in enumerate(
        [(3.0, 0.0), (-3.0, 2.0), (3.0, 2.0), (-3.0, 0.0), (0.0, 1.5)])]).first()
    assert np.allclose(row, [math.log(4), -math.log(4), (16 - 1) / 2, -(16 - 1) / 2, 0.0])


def test_constant_column_stays_finite(spark):
    df = spark.range(10).select(F.lit(3.0).alias("a"))
    out = RFMScaler(inputCols=["a"], outputCols=["x"]).fit(df).transform(df).select("x").distinct().collect()
    assert [r[0] for r in out] == [0.0]


@pytest.mark.parametrize("limit", [100_000, 3])
def test_quantiles_interpolate_like_numpy(spark, limit):
    values = [1.0, 2.0, 3.0, 10.0, None, float("nan")] + [5.0] * 7 + [1e9, -1e9, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = [v for v in values if v is not None and not math.isnan(v)]
    got = exact_quantiles(df, ["v"], [0.0, 0.33, 0.5, 0.66, 1.0], limit)["v"]
    assert np.allclose(got, np.quantile(clean, [0, 0.33, 0.5, 0.66, 1]), rtol=1e-9)
    assert exact_medians(df.filter("v IS NULL"), ["v"])["v"] is None
    assert exact_quantiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), ["v"], [0.5, 0.66])["v"] == pytest.approx([2.5, 2.98])


def test_narrowing_on_many_distinct_values(spark):
    df = lognormal(spark)
    x = df.toPandas()["a"].to_numpy()
    assert exact_quantiles(df, ["a"], [0.1, 0.5, 0.9], 5)["a"] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.9])), rel=1e-12)


def test_quantiles_of_a_million_values_and_of_infinities(spark):
    df = spark.range(1_000_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("a"), F.lit(2.0).alias("b"), F.lit(None).cast("double").alias("c"))
    x = df.select("a").toPandas()["a"].to_numpy()
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    assert got["a"] == pytest.approx(list(np.quantile(x, [0.25, 0.5])), rel=1e-12) and got["b"] == [2.0, 2.0] and got["c"] == [None, None]
    inf = float("inf")
    odd = spark.createDataFrame([(v,) for v in (-inf, -inf, 1.0, 2.0, inf)], "v double")
    assert exact_quantiles(odd, ["v"], [0.0, 0.5, 0.75, 1.0], 2)["v"] == [-inf, 1.0, 2.0, inf]


def test_running_totals_and_positions_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 50)
    df = spark.range(777).select(((F.col("id") * 7919) % 777).cast("double").alias("k"), (F.col("id") % 5).alias("v")).persist()
    got = running_totals(df, "k", {"v": "cum"}, descending=True).orderBy(F.desc("k")).toPandas()
    assert (got["cum"].to_numpy() == got["v"].cumsum().to_numpy()).all()
    placed = global_positions(df, "k").orderBy("k").toPandas()
    assert list(placed["position"]) == list(range(1, 778))


def test_feature_matrix_shape_and_gaps(spark):
    rows = churn(spark, SF_SMALL).persist()
    out, _, model = prepare_churn_features(rows)
    assert len(model.feature_names) == 35
    assert out.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in model.feature_names]).first() == tuple([0] * 35)
    scaled, _, model = prepare_churn_features(rows, scale_features=True)
    means = scaled.agg(*[F.avg(f"`{c}`") for c in model.feature_names]).first()
    assert np.allclose(means, 0, atol=1e-9)


def test_unknown_category_and_test_rows_do_not_leak(spark):
    rows = churn(spark, SF_SMALL).persist()
    train = rows.filter("Gender = 'Male'")
    test = rows.filter("Gender = 'Female'").withColumn("PreferedOrderCat", F.lit("zz"))
    _, out, model = prepare_churn_features(train, test)
    assert "Gender_Female" not in model.feature_names
    hot = [c for c in model.feature_names if c.startswith(("Gender_", "PreferedOrderCat_"))]
    assert out.agg(*[F.max(f"`{c}`") for c in hot]).first() == tuple([0.0] * len(hot))


def test_unfitted_model_refuses(spark):
    with pytest.raises(RuntimeError):
        ChurnFeatureModel().transform(churn(spark, SF_SMALL))


def test_pipeline_round_trip(spark, tmp_path):
    rows = churn(spark, SF_SMALL).persist()
    model = Pipeline(stages=[ChurnFeatureEngineer(scaleFeatures=True)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    a, b = (m.transform(rows).orderBy("CustomerID").toPandas().drop(columns="features") for m in (model, again))
    assert a.equals(b)


def test_batch_scope_uses_own_medians(spark):
    rows = churn(spark, SF_SMALL).persist()
    fitted = ChurnFeatureEngineer(medianScope="batch").fit(rows)
    part = rows.filter(F.col("CustomerID").cast("int") < 20)
    gap = part.withColumn("Tenure", F.when(F.col("CustomerID") != "3", F.col("Tenure")))
    row = fitted.transform(gap).filter("CustomerID = '3'").first()
    med = exact_medians(gap, ["Tenure"])["Tenure"]
    orders = gap.filter("CustomerID = '3'").first()["OrderCount"]
    assert row["OrderVelocity"] == pytest.approx(orders / (med + 1))
    assert len(CATEGORICAL_COLS) == 5


def test_missing_category_may_have_its_own_column(spark):
    from stayflow.operators.churn_features import ChurnFeatureEngineer
    from stayflow.plans.catalog import churn
    from conftest import SF_SMALL

    rows = churn(spark, SF_SMALL).withColumn("Gender", F.when(F.col("Gender") == "Male", F.col("Gender"))).persist()
    zeros = ChurnFeatureEngineer().fit(rows)
    own = ChurnFeatureEngineer(nullCategory="own").fit(rows)
    assert set(own.feature_names) - set(zeros.feature_names) == {"Gender_missing"}
    got = own.transform(rows).agg(F.sum("Gender_missing").alias("m"), F.sum("Gender_Male").alias("n")).first()
    assert got["m"] == rows.where("Gender IS NULL").count() and got["n"] == rows.where("Gender = 'Male'").count()
    assert own.transform(rows.withColumn("Gender", F.lit("else"))).agg(F.sum("Gender_missing")).first()[0] == 0

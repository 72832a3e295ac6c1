"""Churn features: ratios, median imputation, one-hot columns and an optional Z-score, learned on training rows only."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import nan_to_null, q
from stayflow.operators.quantiles import exact_medians
from stayflow.schemas import CATEGORICAL_COLS, DERIVED_COLS, ID_COL, NUMERICAL_COLS, TARGET_COL, require_columns

# Columns whose gaps are filled by a median before the ratios; the other two take fixed values.
RATIO_MEDIAN_COLS = ["Tenure", "OrderCount", "CouponUsed", "DaySinceLastOrder"]
NEUTRAL_SATISFACTION, NO_COMPLAINT = 3.0, 0.0


def _number(name: str) -> Column:
    return nan_to_null(q(name).cast("double"))


def derived_features(medians: dict[str, float | None]) -> dict[str, Column]:
    """The five ratio and interaction features, given the medians used to bridge gaps."""
    filled = {c: F.coalesce(_number(c), F.lit(medians[c])) for c in RATIO_MEDIAN_COLS}
    orders, tenure = filled["OrderCount"], filled["Tenure"]
    complain = F.coalesce(_number("Complain"), F.lit(NO_COMPLAINT))
    satisfaction = F.coalesce(_number("SatisfactionScore"), F.lit(NEUTRAL_SATISFACTION))
    # a tenure of -1 or an order count of -1 would divide by zero, hence try_divide
    return {
        "OrderVelocity": F.try_divide(orders, tenure + 1.0),
        "CouponUsageRatio": F.try_divide(filled["CouponUsed"], orders + 1.0),
        "CashbackPerOrder": F.try_divide(_number("CashbackAmount"), orders + 1.0),
        "ComplainRiskInteraction": complain * (6.0 - satisfaction),
        "InactivityRatio": F.try_divide(filled["DaySinceLastOrder"], tenure * 30.0 + 1.0),
    }


def with_derived(df: DataFrame, medians: dict[str, float | None] | None = None) -> DataFrame:
    """Adds the derived columns; without given medians those of `df` itself are used."""
    medians = medians if medians is not None else exact_medians(df, RATIO_MEDIAN_COLS)
    return df.withColumns(derived_features(medians))


def nonzero_std(std: float | None, mean: float | None) -> float:
    """A constant column keeps its scale; rounding noise around a constant counts as constant."""
    return std if std is not None and std > 1e-12 * max(1.0, abs(mean or 0.0)) else 1.0


class _State(Params):
    scaleFeatures = Param(Params._dummy(), "scaleFeatures", "apply a Z-score to all columns", TypeConverters.toBoolean)
    medianScope = Param(
        Params._dummy(), "medianScope", "fit: ratios use training medians; batch: medians of the transformed rows",
        TypeConverters.toString,
    )

    nullCategory = Param(
        Params._dummy(), "nullCategory", "zeros: a missing category is all zeros; own: it has a column where training had one missing",
        TypeConverters.toString,
    )

    def _features(self) -> str:
        return "features"


class ChurnFeatureEngineer(Estimator, _State, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, category lists and, if asked, means and population deviations."""

    @keyword_only
    def __init__(self, *, scaleFeatures=False, medianScope="fit", nullCategory="zeros"):
        super().__init__()
        self._setDefault(scaleFeatures=False, medianScope="fit", nullCategory="zeros")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ChurnFeatureModel":
        require_columns(df, NUMERICAL_COLS + CATEGORICAL_COLS, "profiles")
        raw = exact_medians(df, NUMERICAL_COLS)
        derived = exact_medians(with_derived(df, raw), DERIVED_COLS)
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), q(c).alias("v")) for c in CATEGORICAL_COLS])
        found: dict[str, list[str | None]] = {c: [] for c in CATEGORICAL_COLS}
        own = self.getOrDefault(self.nullCategory) == "own"
        # as many rows as the model has category columns
        for r in df.select(F.explode(pairs).alias("p")).select("p.*").distinct().orderBy("c", F.col("v").asc_nulls_last()).collect():
            if own or r["v"] is not None:
                found[r["c"]].append(r["v"])
        state = {
            "medians": {**raw, **derived},
            "categories": found,
        }
        args = {"scaleFeatures": self.getOrDefault(self.scaleFeatures), "medianScope": self.getOrDefault(self.medianScope)}
        model = ChurnFeatureModel(state=json.dumps(state), **args)
        if args["scaleFeatures"]:
            cols = model.feature_names
            unscaled = ChurnFeatureModel(state=json.dumps(state), scaleFeatures=False, medianScope="fit").transform(df)
            row = unscaled.agg(
                *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
            ).first()
            state["means"] = [row[f"m{i}"] for i in range(len(cols))]
            state["stds"] = [nonzero_std(row[f"s{i}"], row[f"m{i}"]) for i in range(len(cols))]
            model = ChurnFeatureModel(state=json.dumps(state), **args)
        return model


class ChurnFeatureModel(Model, _State, DefaultParamsReadable, DefaultParamsWritable):
    """Narrow projection to the feature columns and a `features` vector; all input columns but the raw features stay."""

    state = Param(Params._dummy(), "state", "learned values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None, scaleFeatures=False, medianScope="fit"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def learned(self) -> dict:
        if not self.isDefined(self.state):
            raise RuntimeError("the feature model must be fitted before it transforms")
        return json.loads(self.getOrDefault(self.state))

    @property
    def feature_names(self) -> list[str]:
        categories = self.learned["categories"]
        return NUMERICAL_COLS + DERIVED_COLS + [f"{c}_{'missing' if v is None else v}" for c in CATEGORICAL_COLS for v in categories[c]]

    def unscaled(self) -> "ChurnFeatureModel":
        """The model that a fit without the Z-score on the same rows gives, without another pass over them."""
        state = {k: v for k, v in self.learned.items() if k not in ("means", "stds")}
        return ChurnFeatureModel(state=json.dumps(state), scaleFeatures=False, medianScope=self.getOrDefault(self.medianScope))

    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.learned
        medians = learned["medians"]
        bridge = medians
        if self.getOrDefault(self.medianScope) == "batch":
            # medians of the transformed rows, as a parity mode; an all-missing column keeps its gaps
            bridge = exact_medians(df, RATIO_MEDIAN_COLS)
        raw = {c: _number(c) for c in NUMERICAL_COLS} | derived_features(bridge)
        values = [F.coalesce(raw[c], F.lit(medians[c])) for c in NUMERICAL_COLS + DERIVED_COLS]
        for c in CATEGORICAL_COLS:
            values += [q(c).eqNullSafe(F.lit(v)).cast("double") for v in learned["categories"][c]]
        if self.getOrDefault(self.scaleFeatures):
            values = [(v - F.lit(m)) / F.lit(s) for v, m, s in zip(values, learned["means"], learned["stds"])]
        names = self.feature_names
        used = set(NUMERICAL_COLS) | set(CATEGORICAL_COLS)
        kept = [q(c) for c in df.columns if c not in used and c not in names and c != self._features()]
        out = df.select(*kept, *[v.alias(n) for v, n in zip(values, names)])
        return out.withColumn(self._features(), array_to_vector(F.array(*[q(n) for n in names])))


def prepare_churn_features(
    train: DataFrame, test: DataFrame | None = None, scale_features: bool = False
) -> tuple[DataFrame, DataFrame | None, ChurnFeatureModel]:
    """Fit on the training rows only, transform both; the key and the label stay as columns."""
    require_columns(train, [TARGET_COL], "training rows")
    model = ChurnFeatureEngineer(scaleFeatures=scale_features).fit(train)
    return model.transform(train), None if test is None else model.transform(test), model


def feature_columns_only(df: DataFrame) -> DataFrame:
    """Drops the key, the label and the vector if they are there."""
    return df.drop(TARGET_COL, ID_COL, "features")

"""Yeo-Johnson power transform with maximum-likelihood exponents, then Z-score."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q
from stayflow.operators.rfm import RFM_COLS, build_rfm_table

SEARCH_FROM, SEARCH_TO, GRID, PASSES = -5.0, 5.0, 21, 4


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """The transform of Yeo and Johnson (2000); `lam` is a number or a column."""
    return _power_step(x >= 0, F.log1p(F.abs(x)), F.lit(float(lam)) if isinstance(lam, (int, float)) else lam)


def _power_step(upper: Column, log: Column, lam: Column) -> Column:
    """The transform from log(|x| + 1): ((|x| + 1)^e - 1) / e is expm1(e log) / e, which stays exact near e = 0."""
    exponent = F.when(upper, lam).otherwise(2.0 - lam)
    size = F.when(F.abs(exponent) < 1e-12, log).otherwise(F.expm1(exponent * log) / exponent)
    return F.when(upper, size).otherwise(-size)


def log_likelihood(n: int, variance: float | None, lam: float, signed_log_sum: float) -> float:
    if variance is None or not variance > 1e-300 or math.isinf(variance):
        return float("-inf")
    return -n / 2.0 * math.log(variance) + (lam - 1.0) * signed_log_sum


def variance_grid(df: DataFrame, cols: list[str], grids: list[list[float]]) -> DataFrame:
    """Variance `v<i>` of each transformed column for every grid point `g`, for all columns in one aggregate.

    The grid is one array literal that `inline` turns into columns. Generated code refers to such a literal by
    reference, so the grid of the next pass reuses the compiled stage instead of compiling new constants.
    """
    points = ", ".join(
        f"named_struct('g', {g}, " + ", ".join(f"'l{i}', {float(lam)!r}D" for i, lam in enumerate(lams)) + ")"
        for g, lams in enumerate(zip(*grids))
    )
    base = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        base += [(x >= 0).alias(f"u{i}"), F.log1p(F.abs(x)).alias(f"x{i}")]
    moved = [_power_step(F.col(f"u{i}"), F.col(f"x{i}"), F.col(f"l{i}")) for i in range(len(cols))]
    return (
        df.select(*base)
        .select("*", F.expr(f"inline(array({points}))"))
        .groupBy("g")
        .agg(
            *[F.var_pop(m).alias(f"v{i}") for i, m in enumerate(moved)],
            *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(cols))],
            # sum of sign(x) log(|x| + 1), the Jacobian term of the likelihood
            *[F.sum(F.when(F.col(f"u{i}"), F.col(f"x{i}")).otherwise(-F.col(f"x{i}"))).alias(f"s{i}") for i in range(len(cols))],
            *[F.first(f"l{i}").alias(f"l{i}") for i in range(len(cols))],
        )
    )


def likelihood_table(df: DataFrame, cols: list[str], grid: list[float]) -> DataFrame:
    """Log likelihood per column and exponent of a common grid, as rows (column, lambda, log_likelihood)."""
    wide = variance_grid(df, cols, [grid] * len(cols))
    score = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"l{i}").alias("lambda"),
            (-F.col(f"n{i}") / 2 * F.ln(f"v{i}") + (F.col(f"l{i}") - 1) * F.col(f"s{i}")).alias("log_likelihood"),
        )
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(score))


def fit_lambdas(df: DataFrame, cols: list[str], passes: int = PASSES) -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    Each pass is one aggregate over a grid and shrinks the bracket ten-fold; a parabola through the best point
    and its neighbours of the last pass settles the remaining digits.
    """
    lo, hi = [SEARCH_FROM] * len(cols), [SEARCH_TO] * len(cols)
    best = [1.0] * len(cols)
    for step_no in range(passes):
        grids = [[lo[i] + (hi[i] - lo[i]) * j / (GRID - 1) for j in range(GRID)] for i in range(len(cols))]
        rows = sorted(variance_grid(df, cols, grids).collect(), key=lambda r: r["g"])  # GRID rows
        for i in range(len(cols)):
            scores = [log_likelihood(r[f"n{i}"], r[f"v{i}"], r[f"l{i}"], r[f"s{i}"] or 0.0) for r in rows]
            top = max(scores, default=float("-inf"))
            if top == float("-inf"):  # constant or empty column: leave it as it is
                continue
            at = scores.index(top)
            best[i] = grids[i][at]
            step = (hi[i] - lo[i]) / (GRID - 1)
            lo[i], hi[i] = best[i] - step, best[i] + step
            if step_no == passes - 1 and 0 < at < GRID - 1:
                best[i] += step * _parabola_top(scores[at - 1], top, scores[at + 1])
    return dict(zip(cols, best))


def _parabola_top(left: float, mid: float, right: float) -> float:
    """Offset of the vertex from the middle of three equally spaced points, in steps."""
    bend = left - 2 * mid + right
    return 0.5 * (left - right) / bend if bend < 0 and math.isfinite(bend) else 0.0


class _ScalerParams(HasInputCols, HasOutputCols, HasOutputCol):
    lambdas = Param(Params._dummy(), "lambdas", "exponent per input column", typeConverter=TypeConverters.toListFloat)

    def getLambdas(self) -> list[float]:
        return self.getOrDefault(self.lambdas)


class RFMScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits exponents (unless `lambdas` is given), means and population deviations."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, outputCol="features", lambdas=None):
        super().__init__()
        self._setDefault(inputCols=list(RFM_COLS), outputCols=[f"{c}_scaled" for c in RFM_COLS], outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "RFMScalerModel":
        cols = self.getInputCols()
        outputs = self.getOutputCols() if len(self.getOutputCols()) == len(cols) else [f"{c}_scaled" for c in cols]
        if self.isDefined(self.lambdas):
            lambdas = self.getLambdas()
        else:
            fitted = fit_lambdas(df, cols)
            lambdas = [fitted[c] for c in cols]
        moved = [yeo_johnson(q(c).cast("double"), lam) for c, lam in zip(cols, lambdas)]
        stats = df.agg(
            *[F.avg(m).alias(f"m{i}") for i, m in enumerate(moved)],
            *[F.stddev_pop(m).alias(f"s{i}") for i, m in enumerate(moved)],
        ).first()
        means = [stats[f"m{i}"] or 0.0 for i in range(len(cols))]
        stds = [stats[f"s{i}"] or 1.0 for i in range(len(cols))]
        return RFMScalerModel(
            inputCols=cols, outputCols=outputs, outputCol=self.getOutputCol(), lambdas=lambdas, means=means, stds=stds
        )


class RFMScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per column", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population deviation per column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, outputCol=None, lambdas=None, means=None, stds=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = [
            ((yeo_johnson(q(c).cast("double"), lam) - m) / s)
            for c, lam, m, s in zip(
                self.getInputCols(), self.getLambdas(), self.getOrDefault(self.means), self.getOrDefault(self.stds)
            )
        ]
        out = df.withColumns(dict(zip(self.getOutputCols(), scaled)))
        return out.withColumn(self.getOutputCol(), array_to_vector(F.array(*[q(c) for c in self.getOutputCols()])))


def build_scaled_rfm_features(df: DataFrame, **kwargs) -> tuple[DataFrame, RFMScalerModel]:
    """RFM table with raw and scaled columns plus the fitted scaler.

    The table is kept (memory, then disk) because every search pass reads it; it is one row per customer.
    """
    rfm = build_rfm_table(df, **kwargs).persist()
    model = RFMScaler().fit(rfm)
    return model.transform(rfm), model

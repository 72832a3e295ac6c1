"""Classifier quality: confusion counts, ROC-AUC, average precision, class weights."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.columns import q, safe_ratio
from stayflow.functions.rules import churn_prediction
from stayflow.operators.ordered import running_totals


def class_ratio(df: DataFrame, label_col: str = "Churn") -> DataFrame:
    """Negatives per positive; null when there is no positive."""
    y = q(label_col)
    return df.agg(F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives")).withColumn(
        "scale_pos_weight", F.try_divide("negatives", "positives")
    )


def calculate_scale_pos_weight(df: DataFrame, label_col: str = "Churn") -> float | None:
    return class_ratio(df, label_col).first()["scale_pos_weight"]


def class_weights(df: DataFrame, label_col: str = "Churn") -> DataFrame:
    """Balanced weight n / (classes x rows of the class), from one aggregate of a row per class."""
    per_class = df.groupBy(q(label_col).alias(label_col)).agg(F.count(F.lit(1)).alias("n_rows"))
    total = per_class.agg(F.struct(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return per_class.withColumn("weight", total.getField("n") / (total.getField("k") * F.col("n_rows")))


def weight_expr(counts: dict[int, int], label_col: str) -> Column:
    """Balanced weight as a column, from class counts on the driver."""
    total, k = sum(counts.values()), len(counts)
    out = F.lit(1.0)
    for label, n in counts.items():
        out = F.when(q(label_col) == label, F.lit(total / (k * n))).otherwise(out)
    return out


def confusion(df: DataFrame, label_col: str = "Churn", pred_col: str = "churn_prediction") -> DataFrame:
    """The four counts with precision, recall and F1; undefined ratios are 0."""
    y, p = q(label_col) == 1, q(pred_col) == 1
    counts = df.agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1_score": safe_ratio(2 * tp, 2 * tp + fp + fn),
    })


def score_table(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Positives and negatives per distinct score. A score shared by a third of all rows becomes one row."""
    y = q(label_col)
    return df.groupBy(q(score_col).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def ranking_metrics(df: DataFrame, label_col: str = "Churn", score_col: str = "p") -> DataFrame:
    """ROC-AUC (ties count half) and average precision, exact, from running counts over distinct scores."""
    # kept, because range cuts, range totals and running counts each read it; scoring runs once
    return _ranking(score_table(df, label_col, score_col).persist())


def _ranking_now(df: DataFrame, label_col: str, score_col: str):
    """The row of `ranking_metrics`, with its kept table released."""
    table = score_table(df, label_col, score_col).persist()
    try:
        return _ranking(table).first()
    finally:
        table.unpersist()


def _ranking(table: DataFrame) -> DataFrame:
    scores = running_totals(table, "score", {"pos": "cum_pos", "neg": "cum_neg"}, descending=True)
    sums = scores.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))).alias("hits"),
    )
    return sums.select(
        "n_pos", "n_neg",
        F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"),
        F.try_divide(F.col("hits"), F.col("n_pos")).alias("pr_auc"),
    )


def evaluate_model_performance(
    model_name: str, df: DataFrame, label_col: str = "Churn", score_col: str = "p"
) -> dict[str, float | str]:
    """Metric record of a scored table; the class is 1 from a probability of 0.5 on."""
    # kept, because ranks and counts each read it; the model scores once
    scored = df.select(q(label_col), q(score_col)).withColumn("_pred", churn_prediction(q(score_col))).persist()
    try:
        ranks = _ranking_now(scored, label_col, score_col)
        conf = confusion(scored, label_col, "_pred").first()
    finally:
        scored.unpersist()
    return {
        "model_name": model_name, "roc_auc": ranks["roc_auc"], "pr_auc": ranks["pr_auc"], "f1_score": conf["f1_score"],
        "precision": conf["precision"], "recall": conf["recall"],
    }


def positive_probability(col: str = "probability") -> Column:
    return F.element_at(vector_to_array(q(col)), 2)


class AveragePrecisionEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Average precision of the `probability` column, for CrossValidator. MLlib's areaUnderPR is a trapezoid instead."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", probabilityCol="probability"):
        super().__init__()
        self._setDefault(labelCol="label", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        label = self.getOrDefault(self.labelCol)
        scored = dataset.select(
            q(label).cast("int").alias("y"), positive_probability(self.getOrDefault(self.probabilityCol)).alias("p")
        )
        return _ranking_now(scored, "y", "p")["pr_auc"] or 0.0

    def isLargerBetter(self) -> bool:
        return True

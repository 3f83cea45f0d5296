"""Accuracy metrics over actual/predicted pairs, in three views from one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("mape", "wmape", "rmse", "mae", "smape")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def metric_columns(actual: str = "actual", predicted: str = "value") -> list[Column]:
    """The five metrics, accuracy and pair count; null means not measurable."""
    a, p = F.col(actual), F.col(predicted)
    e = F.abs(a - p)
    wmape = F.sum(e) / F.nullif(F.sum(F.abs(a)), F.lit(0.0)) * 100
    middle = (F.abs(a) + F.abs(p)) / 2
    return [
        (F.avg(F.when(a != 0, e / F.abs(a))) * 100).alias("mape"),
        wmape.alias("wmape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mae"),
        (F.avg(F.coalesce(e / F.nullif(middle, F.lit(0.0)), F.lit(0.0))) * 100).alias("smape"),
        F.greatest(F.lit(0.0), 100 - wmape).alias("accuracy"),
        F.count(F.lit(1)).alias("observations"),
    ]


def backtest_pairs(predictions: DataFrame) -> DataFrame:
    """Scored pairs: backtest folds whose prediction and actual are both finite."""
    return predictions.where((F.col("fold") >= 0) & finite(F.col("actual")) & finite(F.col("value")))


def backtest_views(predictions: DataFrame) -> DataFrame:
    """`view` overall | fold | step. Overall pools all pairs; it is not the mean of folds."""
    pairs = backtest_pairs(predictions)
    keys = ["group_id", "model_name"]
    sets = [keys, [*keys, "fold"], [*keys, "step"]]
    view = F.when(F.grouping("fold") == 0, "fold").when(F.grouping("step") == 0, "step").otherwise("overall")
    scored = pairs.groupingSets(
        [[F.col(c) for c in s] for s in sets], "group_id", "model_name", "fold", "step"
    ).agg(view.alias("view"), *metric_columns())
    return scored


def overall(predictions: DataFrame) -> DataFrame:
    """Pooled metrics per (group, model), plus the number of folds used."""
    return backtest_pairs(predictions).groupBy("group_id", "model_name").agg(
        *metric_columns(), F.size(F.collect_set("fold")).alias("folds")  # at most max_folds values
    )


def backtest_status(trained: DataFrame, scores: DataFrame, needed: int = 15) -> DataFrame:
    """Why a trained pair has no backtest, null where it has one."""
    joined = trained.where(F.col("status") == "Trained").join(scores, ["group_id", "model_name"], "left")
    reason = F.when(F.col("n") < needed, F.lit("too few observations to backtest")).when(
        F.col("observations").isNull(), F.lit("no fold could be evaluated")
    )
    return joined.withColumn("skipped_reason", reason)

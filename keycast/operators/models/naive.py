"""Seasonal naive: the last full cycle repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tests(regressors: list[str] = ()):
    """Aggregate: the test rows of a fold as an array (at most one horizon long)."""
    row = F.struct(F.col("step"), F.col("ds"), F.col("y").alias("actual"), *[F.col(c) for c in regressors])
    return F.collect_list(F.when(F.col("part") == "test", row)).alias("tests")


def newest(frame: DataFrame, rows: int) -> DataFrame:
    """Add `_newest`: whether a training row is among the newest `rows` of its fold, so that no more of them are ever gathered."""
    last = F.max(F.when(F.col("part") == "train", F.col("t"))).over(Window.partitionBy("group_id", "fold"))
    return frame.withColumn("_newest", (F.col("part") == "train") & (F.col("t") > last - rows))


def predict(frame: DataFrame, period: int = 12) -> DataFrame:
    """A series shorter than one period repeats its last value."""
    per_fold = newest(frame, period).groupBy("group_id", "fold").agg(
        F.sort_array(F.collect_list(F.when(F.col("_newest"), F.struct("t", "y")))).alias("history"),
        tests(),
    )
    full = F.size("history") >= period
    cycle = per_fold.where(F.size("history") > 0).select(
        "group_id", "fold",
        F.when(full, F.lit(period)).otherwise(F.lit(1)).alias("cycle"),
        F.transform(F.slice("history", -F.when(full, F.lit(period)).otherwise(F.lit(1)), F.lit(period)), lambda r: r["y"]).alias("tail"),
        "tests",
    )
    steps = cycle.select("group_id", "fold", "cycle", "tail", F.inline("tests"))
    return steps.select(
        "group_id", F.lit("seasonal_naive").alias("model_name"), "fold", "step", "ds", "actual",
        F.element_at("tail", (F.pmod(F.col("step") - 1, F.col("cycle")) + 1).cast("int")).alias("value"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
    )

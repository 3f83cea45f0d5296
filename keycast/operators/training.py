"""Which (group, model) pairs are trained, and the counts per outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast.config import ModelSpec, resolve_models


def eligibility(facts: DataFrame, specs: tuple[ModelSpec, ...] | None = None, unavailable: set[str] = frozenset()) -> DataFrame:
    """`group_id, model_name, model_position, status, detail` from `group_id, n`.

    The registry is a fixed handful of rows, expanded in place rather than joined.
    """
    specs = specs or resolve_models()
    rows = F.array(*[
        F.struct(
            F.lit(s.name).alias("model_name"), F.lit(i).alias("model_position"),
            F.lit(s.min_rows).alias("min_rows"), F.lit(s.name in unavailable).alias("unavailable"),
        )
        for i, s in enumerate(specs)
    ])
    pairs = facts.select("group_id", "n", F.inline(rows))
    status = F.when(F.col("unavailable"), "Unavailable").when(F.col("n") < F.col("min_rows"), "Skipped").otherwise("Trained")
    short = F.format_string("Group has %d observation(s); '%s' requires at least %d.", F.col("n"), F.col("model_name"), F.col("min_rows"))
    detail = F.when(F.col("unavailable"), F.lit("The model is not available in this deployment.")).when(F.col("n") < F.col("min_rows"), short)
    return pairs.select("group_id", "n", "model_name", "model_position", status.alias("status"), detail.alias("detail"))


def mark_failed(trained: DataFrame, forecasts: DataFrame, horizon: int) -> DataFrame:
    """A trained pair whose forward forecast does not cover the horizon has failed."""
    covered = forecasts.where(F.col("value").isNotNull()).groupBy("group_id", "model_name").agg(F.count(F.lit(1)).alias("steps"))
    joined = trained.join(covered, ["group_id", "model_name"], "left")
    short = (F.col("status") == "Trained") & (F.coalesce(F.col("steps"), F.lit(0)) < horizon)
    return joined.withColumn("status", F.when(short, "Failed").otherwise(F.col("status"))).drop("steps")


def status_counts(pairs: DataFrame, column: str = "status") -> DataFrame:
    return pairs.groupBy(column).agg(F.count(F.lit(1)).alias("pairs"))


def training_report(pairs: DataFrame) -> DataFrame:
    """One row: groups, pairs and a count per status."""
    counts = [
        F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Trained", "Skipped", "Failed", "Unavailable")
    ]
    return pairs.agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("pairs"), *counts)

"""Production choice: the best-ranked model whose forecast passes the drift gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import FALLBACK_MODEL

PAIR = ["group_id", "model_name"]
# Fixed values, here and in `select_production`: statuses and fallback triggers that readers of the table match on.
NO_CANDIDATE = "No ranked candidate survived earlier validation stages."


def judged_candidates(ranked: DataFrame, drift: DataFrame) -> DataFrame:
    """Ranked models with their drift verdict and the rank of their group's winner.

    Survivors number a handful per key, so judging all of them set-wise costs
    less than walking them one by one.
    """
    joined = ranked.join(drift, PAIR, "left")
    passed = F.coalesce(F.col("passed"), F.lit(False))
    winner = F.min(F.when(passed, F.col("final_rank"))).over(Window.partitionBy("group_id"))
    detail = F.coalesce(F.col("detail"), F.lit("No forward forecast is available to validate."))
    return joined.withColumn("passed", passed).withColumn("detail", detail).withColumn("winner_rank", winner)


def rejected(judged: DataFrame) -> DataFrame:
    """Candidates tried before the winner (all of them when nothing passed)."""
    return judged.where(F.col("winner_rank").isNull() | (F.col("final_rank") < F.col("winner_rank")))


def failures(trained: DataFrame, judged: DataFrame) -> DataFrame:
    """`group_id, failure_reason`: what went wrong on the way, by step and model, of every group with a failed step."""
    say = lambda step, reason: F.concat(F.lit(step), F.col("model_name"), F.lit(": "), reason)
    unfit = trained.where("status = 'Failed'").select("group_id", say("training ", F.coalesce("detail", F.lit("no forecast for the whole horizon"))).alias("r"))
    unjudged = judged.where("error IS NOT NULL").select("group_id", say("drift ", F.col("error")).alias("r"))
    return unfit.unionByName(unjudged).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("r")), "; ").alias("failure_reason"))


def select_production(groups: DataFrame, judged: DataFrame, naive: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per group: winner or fallback, its status and how it came about.

    `groups` is every group; `naive` the fallback's forward forecast rows;
    `failed` what `failures` lists. A group without winner and fallback is
    "Failed" if one of its steps failed, else "No Model Available". Other groups are what they are without it.
    """
    tried = judged.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "model_name"))), lambda r: r["model_name"]).alias("original_candidates"),
        F.transform(
            F.array_sort(F.collect_list(F.when(
                F.col("winner_rank").isNull() | (F.col("final_rank") < F.col("winner_rank")),
                F.struct("final_rank", "model_name", F.col("detail").alias("reason"), "algorithm", "statistic", F.col("method").alias("threshold_method"), "threshold"),
            ))),
            lambda r: F.struct(r["model_name"].alias("model_name"), r["reason"].alias("reason"), r["algorithm"].alias("algorithm"), r["statistic"].alias("statistic"), r["threshold_method"].alias("threshold_method"), r["threshold"].alias("threshold")),
        ).alias("rejected_candidates"),
        F.max_by(
            F.struct("model_name", "composite_score", "backtest_rank", "final_rank", "algorithm", "method", "statistic", "threshold"),
            F.when(F.col("final_rank") == F.col("winner_rank"), F.lit(1)),
        ).alias("won"),
    )
    able = naive.where(F.col("value").isNotNull()).select("group_id").distinct().withColumn("has_fallback", F.lit(True))
    out = groups.select("group_id").join(tried, "group_id", "left").join(able, "group_id", "left")
    out = out.withColumn("failure_reason", F.lit(None).cast("string")) if failed is None else out.join(failed, "group_id", "left")
    fallback = F.col("won").isNull()
    count = F.size(F.coalesce("original_candidates", F.array().cast("array<string>")))
    trigger = F.when(
        count > 0,
        F.concat(F.lit("All "), count.cast("string"), F.lit(" evaluated model(s) failed validation ("), F.array_join("original_candidates", ", "), F.lit(").")),
    ).otherwise(F.lit(NO_CANDIDATE))
    status = F.when(~fallback, "Selected").when(F.coalesce("has_fallback", F.lit(False)), "Fallback Model Used").when(F.col("failure_reason").isNotNull(), "Failed").otherwise("No Model Available")
    name = F.when(~fallback, F.col("won.model_name")).when(F.coalesce("has_fallback", F.lit(False)), F.lit(FALLBACK_MODEL))
    return out.select(
        "group_id",
        name.alias("model_name"),
        status.alias("status"),
        (status == "Fallback Model Used").alias("fallback_used"),
        F.when(fallback, trigger).alias("fallback_trigger"),
        F.col("won.composite_score").alias("composite_score"),
        F.col("won.backtest_rank").alias("backtest_rank"),
        F.col("won.final_rank").alias("final_rank"),
        F.col("won.algorithm").alias("algorithm"),
        F.col("won.method").alias("threshold_method"),
        F.col("won.statistic").alias("statistic"),
        F.col("won.threshold").alias("threshold"),
        F.coalesce("original_candidates", F.array().cast("array<string>")).alias("original_candidates"),
        "rejected_candidates", "failure_reason",
    )


def winning_forecasts(selection: DataFrame, forecasts: DataFrame, naive: DataFrame) -> DataFrame:
    """Forward rows of each group's production model, the fallback's where it was used."""
    chosen = forecasts.join(selection.where("status = 'Selected'").select(*PAIR), PAIR, "left_semi")
    covered = naive.join(selection.where("fallback_used").select("group_id"), "group_id", "left_semi")
    return chosen.unionByName(covered)


def selection_report(selection: DataFrame) -> DataFrame:
    counts = [
        F.count_if(F.col("status") == label).alias(name)
        for name, label in (("selected", "Selected"), ("fallback_used", "Fallback Model Used"), ("no_model", "No Model Available"), ("failed", "Failed"))
    ]
    return selection.agg(F.count(F.lit(1)).alias("groups"), *counts)


def fallback_report(selection: DataFrame) -> DataFrame:
    """Groups on the fallback: trigger, candidates tried, reasons each was refused."""
    reasons = F.transform(
        F.coalesce("rejected_candidates", F.array().cast(selection.schema["rejected_candidates"].dataType)),
        lambda r: F.concat(r["model_name"], F.lit(": "), r["reason"]),
    )
    return selection.where("fallback_used").select(
        "group_id", "fallback_trigger",
        F.array_join("original_candidates", ", ").alias("original_candidates"),
        F.array_join(reasons, "; ").alias("reasons"),
    )

"""Aggregates over a table of insight calls, one row per attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast.functions.skew import running_total

MIN_TOKENS_LEFT = 200
PROVIDER = "azure_openai"  # fixed value: any other provider means a fallback text


def _known_cost() -> Column:
    """Total cost, only if every token-bearing call is priced."""
    priced = F.count("cost") == F.count_if(F.col("total_tokens") > 0)
    return F.when(priced & (F.count("cost") > 0), F.round(F.sum("cost"), 6))


def _rate(good: Column, bad: Column) -> Column:
    return F.round(good / F.nullif(good + bad, F.lit(0)), 4)


def call_cost(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Add `cost` from per-1k token prices by tier; an unpriced tier or missing count gives null."""
    inputs = outputs = F.lit(None).cast("double")
    for tier, (per_in, per_out) in prices.items():
        inputs = F.when(F.col("routing_tier") == tier, F.lit(per_in)).otherwise(inputs)
        outputs = F.when(F.col("routing_tier") == tier, F.lit(per_out)).otherwise(outputs)
    return calls.withColumn("cost", F.col("prompt_tokens") / 1000.0 * inputs + F.col("completion_tokens") / 1000.0 * outputs)


def run_summaries(calls: DataFrame) -> DataFrame:
    grounded, ungrounded = F.count_if(F.col("grounding_status") == "grounded"), F.count_if(F.col("grounding_status") == "ungrounded")
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("call_count"), *tokens,
        F.round(F.avg("latency_ms"), 1).alias("average_latency_ms"),
        _known_cost().alias("cost"),
        F.count_if(F.col("attempt_number") > 1).alias("retry_count"),
        _rate(grounded, ungrounded).alias("groundedness_rate"),
    )


def status_histogram(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "final_status").agg(F.count(F.lit(1)).alias("calls"))


def group_calls(calls: DataFrame) -> DataFrame:
    """One row per (run, group): the last attempt's facts; attempts are counted, not carried. Calls without a group have no row.

    Counting keeps a group with very many attempts out of one row's memory.
    """
    last = F.max_by(F.struct("provider", "prompt_version", "total_tokens", "latency_ms", "validation_status", "grounding_status", "final_status"), "attempt_number")
    out = calls.where(F.col("group_id").isNotNull()).groupBy("run_id", "group_id").agg(last.alias("last"), F.count(F.lit(1)).alias("attempts"))
    return out.select("run_id", "group_id", "last.*", "attempts", (F.col("attempts") - 1).alias("retry_count"))


def attempts_json(calls: DataFrame) -> DataFrame:
    """Attempts of each (run, group) in order, as an array; attempts per group are limited by the retry setting."""
    row = F.struct("attempt_number", "final_status", "total_tokens")
    return calls.groupBy("run_id", "group_id").agg(F.array_sort(F.collect_list(row)).alias("attempts"))


def usage_by_version(calls: DataFrame) -> DataFrame:
    """Per prompt version: usage from run totals, quality rates from each group's final answer."""
    version = calls.groupBy("run_id").agg(F.max("prompt_version").alias("prompt_version"))
    runs = run_summaries(calls).join(version, "run_id")
    weighted = F.when(F.col("average_latency_ms").isNotNull(), F.col("average_latency_ms") * F.col("call_count"))
    counted = F.when(F.col("average_latency_ms").isNotNull(), F.col("call_count"))
    usage = runs.groupBy("prompt_version").agg(
        F.count(F.lit(1)).alias("runs_included"), F.sum("call_count").alias("call_count"), F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum(weighted) / F.nullif(F.sum(counted), F.lit(0)), 1).alias("average_latency_ms"),
        F.when(F.count("cost") == F.count(F.lit(1)), F.round(F.sum("cost"), 6)).alias("cost"),
    )
    groups = group_calls(calls).drop("prompt_version").where(F.col("provider") != "none").join(version, "run_id")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    total = F.count(F.lit(1))
    quality = groups.groupBy("prompt_version").agg(
        _rate(is_("grounding_status", "grounded"), is_("grounding_status", "ungrounded")).alias("groundedness_rate"),
        _rate(is_("validation_status", "passed"), is_("validation_status", "failed")).alias("validation_pass_rate"),
        F.round(F.count_if(F.col("retry_count") > 0) / total, 4).alias("retry_rate"),
        F.round(F.count_if(F.col("provider") != PROVIDER) / total, 4).alias("fallback_rate"),
    )
    return usage.join(quality, "prompt_version", "left")


def over_budget(calls: DataFrame, budget: int) -> DataFrame:
    """Per (run, group) in order: tokens used before it, and whether the budget was spent by then."""
    per_group = calls.groupBy("run_id", "group_id").agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"))
    used = running_total(per_group, ["run_id"], ["group_id"], "tokens", "tokens_before")
    return used.withColumn("skipped", F.lit(budget) - F.col("tokens_before") < MIN_TOKENS_LEFT)


def routing_tier(rejected_count: Column) -> Column:
    return F.when(rejected_count > 1, "complex").otherwise("simple")

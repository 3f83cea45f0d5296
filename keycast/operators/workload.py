"""Estimating a run before it starts, from key depth and past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast.config import MODELS
from keycast.operators.folds import fold_count

# Planning constants used until enough runs have been measured.
SECONDS_PER_FIT = {"seasonal_naive": 0.02, "autoregressive": 0.9, "trend_seasonal": 1.6, "random_forest": 0.3, "boosted_trees": 0.35}
AVERAGE_FIT = 0.75
SECONDS_PER_IMPORTANCE = 0.5
SECONDS_PER_CALL = 2.5
PROMPT_TOKENS, COMPLETION_TOKENS = 1100.0, 110.0
FIXED_SECONDS = 20.0
LOW, HIGH = 0.7, 1.6
TUNING_ROWS = 48
RUNS_NEEDED = 3
MAX_STARTUP = 900.0


def _models(names: list[str] | None) -> list:
    return [m for m in MODELS if (m.name in names if names else m.candidate)]


def depth_folds(periods: Column) -> Column:
    """Backtest folds a history of this many months supports."""
    return fold_count(periods).cast("long")


def workload(depth: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Counts of the work a run will do; `depth` is one row per key with `periods`."""
    models = _models(names)
    n = F.col("periods")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    eligible = sum((F.when(n >= m.min_rows, 1).otherwise(0) for m in models), F.lit(0))
    tuned = F.when(n >= TUNING_ROWS, F.lit(sum(1 for m in models if m.name != "seasonal_naive"))).otherwise(0)
    groups = F.count(F.lit(1))
    return depth.agg(
        groups.alias("groups"), F.lit(len(models)).cast("long").alias("models_per_group"), (groups * len(models)).alias("evaluations"),
        total(depth_folds(n) * len(models)).alias("folds"), total(depth_folds(n)).alias("folds_per_model"),
        total(eligible).alias("eligible_pairs"), total(tuned).alias("tuning_pairs"), groups.alias("insight_calls"),
    )


def calibration(summaries: DataFrame) -> DataFrame:
    """Median seconds per unit of work over all completed runs.

    `summaries`: run_id, started_at, status, duration_seconds, stage_seconds,
    backtest_seconds, folds, train_seconds, trained, importance_seconds,
    survivors, latency_ms.
    """
    read = summaries.where("status = 'Completed'")
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    fits = F.array_compact(F.array(ratio("backtest_seconds", "folds"), ratio("train_seconds", "trained")))
    overhead = F.col("duration_seconds") - F.col("stage_seconds")
    rows = read.withColumn("fits", fits).withColumn("overhead", F.when(overhead.between(0.0, MAX_STARTUP), overhead))
    facts = rows.agg(
        F.count_if(F.size("fits") > 0).alias("runs_used"),
        F.median(ratio("importance_seconds", "survivors")).alias("per_importance"),
        F.median(F.col("latency_ms") / 1000.0).alias("per_call"),
        F.count("overhead").alias("startups"),
        F.median("overhead").alias("startup"),
    ).withColumn("_one", F.lit(1))
    per_fit = rows.select(F.explode("fits").alias("fit")).agg(F.median("fit").alias("per_fit")).withColumn("_one", F.lit(1))
    enough = (F.col("runs_used") >= RUNS_NEEDED) & F.col("per_fit").isNotNull()
    pick = lambda c, default: F.when(enough, F.coalesce(F.col(c), F.lit(default))).otherwise(F.lit(default))
    return facts.join(per_fit, "_one").select(
        "runs_used",
        pick("per_fit", AVERAGE_FIT).alias("seconds_per_fit"),
        pick("per_importance", SECONDS_PER_IMPORTANCE).alias("seconds_per_importance"),
        pick("per_call", SECONDS_PER_CALL).alias("seconds_per_call"),
        F.when(F.col("startups") >= RUNS_NEEDED, F.col("startup")).alias("startup_seconds"),
    )


def runtime(work: DataFrame, calibrated: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Seconds a run should take, with its low and high bound. Both inputs are one row."""
    weight = sum(SECONDS_PER_FIT.get(m.name, AVERAGE_FIT) / AVERAGE_FIT for m in _models(names))
    joined = work.withColumn("_one", F.lit(1)).join(calibrated.withColumn("_one", F.lit(1)), "_one")
    fits = (F.col("groups") + F.col("folds_per_model")) * F.col("seconds_per_fit") * weight
    seconds = FIXED_SECONDS + fits + F.col("eligible_pairs") * F.col("seconds_per_importance") + F.col("insight_calls") * F.col("seconds_per_call")
    out = joined.withColumn("seconds", seconds)
    return out.select("*", (F.col("seconds") * LOW).alias("low_seconds"), (F.col("seconds") * HIGH).alias("high_seconds")).drop("_one")


def cost(estimate: DataFrame, rate_per_hour: float | None, price_in: float | None, price_out: float | None) -> DataFrame:
    """Cost range: compute hours plus tokens. A part without a rate is null and left out of the total."""
    null = F.lit(None).cast("double")
    compute = lambda c: F.round(F.col(c) / 3600.0 * rate_per_hour, 2) if rate_per_hour else null
    if price_in is None or price_out is None:
        tokens = lambda f: null
    else:
        per_call = PROMPT_TOKENS / 1000.0 * price_in + COMPLETION_TOKENS / 1000.0 * price_out
        tokens = lambda f: F.when(F.col("insight_calls") > 0, F.round(F.col("insight_calls") * per_call * f, 4))
    out = estimate.withColumn("compute_low", compute("low_seconds")).withColumn("compute_high", compute("high_seconds"))
    out = out.withColumn("token_low", tokens(LOW)).withColumn("token_high", tokens(HIGH))
    total = lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.round(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), 2))
    return out.withColumn("total_low", total("compute_low", "token_low")).withColumn("total_high", total("compute_high", "token_high"))

"""From a curated table to one long series table keyed by `group_id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.config import KEY_SEPARATOR, SINGLE_SERIES_ID, Cleaning, Roles
from keycast.functions.skew import spread
from keycast.operators.coercion import is_number


def group_id(roles: Roles) -> Column:
    if not roles.keys:
        return F.lit(SINGLE_SERIES_ID)
    # A bar inside a part is escaped, so that different keys never join to one text.
    part = lambda k: F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws(KEY_SEPARATOR, *[part(k) for k in roles.keys])


def group_keys(roles: Roles) -> Column:
    if not roles.keys:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[part for k in roles.keys for part in (F.lit(k), F.col(k).cast("string"))])


def grouped(curated: DataFrame, roles: Roles) -> DataFrame:
    """Rows with their group; a row with a null key belongs to none and is left out."""
    kept = curated.dropna(subset=list(roles.keys)) if roles.keys else curated
    return kept.withColumn("group_id", group_id(roles))


def usable_features(curated: DataFrame, roles: Roles) -> list[str]:
    """Features a model can take: the numeric ones."""
    return [c for c in roles.features if is_number(curated.schema[c].dataType)]


def build_series(curated: DataFrame, roles: Roles, options: Cleaning = Cleaning()) -> DataFrame:
    """`group_id, t, n, ds, y, features…`, hash-partitioned by group once for all later stages.

    After the roll-up a series has at most one row per month, so the window
    per group is bounded by the calendar, not by the input size.
    """
    rows = grouped(curated, roles).select(
        "group_id", F.col(roles.date).cast("date").alias("ds"), F.col(roles.target).cast("double").alias("y"), *roles.features
    )
    rows = spread(rows, "group_id")
    w = Window.partitionBy("group_id")
    series = rows.withColumn("n", F.count(F.lit(1)).over(w).cast("int"))
    series = series.withColumn("t", (F.row_number().over(w.orderBy("ds")) - 1).cast("int"))
    if options.drop_thin_groups:
        series = series.where(F.col("n") >= options.min_rows_per_group)
    return series.select("group_id", "t", "n", "ds", "y", *roles.features)


def series_facts(series: DataFrame, options: Cleaning = Cleaning()) -> DataFrame:
    return series.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.min("ds").alias("start_date"),
        F.max("ds").alias("end_date"),
        (F.count(F.lit(1)) >= options.min_rows_per_group).alias("meets_minimum"),
    )


def recent_history(series: DataFrame, points: int = 24) -> DataFrame:
    """The trailing `points` observations of every series."""
    return series.where(F.col("t") >= F.col("n") - points)


def median_days(gaps: Column) -> Column:
    """Median spacing in days as a double; 30 where nothing positive was measured."""
    median = F.median(gaps)
    return F.when(median.isNull() | (median <= 0), F.lit(30.0)).otherwise(median.cast("double"))


def with_gaps(series: DataFrame, keys: list[str]) -> DataFrame:
    previous = F.lag("ds").over(Window.partitionBy(*keys).orderBy("t"))
    return series.withColumn("gap_days", F.datediff("ds", previous))


def future_dates(series: DataFrame, horizon: int) -> DataFrame:
    """`group_id, step, ds`: last date plus k times the median spacing."""
    facts = with_gaps(series, ["group_id"]).groupBy("group_id").agg(
        F.max("ds").alias("last_ds"), median_days(F.col("gap_days")).alias("step_days")
    )
    steps = facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select("group_id", "step", future_day(F.col("last_ds"), F.col("step_days"), F.col("step")).alias("ds"))


def future_day(last: Column, step_days: Column, step: Column) -> Column:
    return F.date_add(last, F.floor(step_days * step).cast("int"))

"""Read-only measurements of a raw table: completeness, timeline, grain, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keycast.config import FREQUENCY_BANDS, IRREGULAR, Quality, Roles
from keycast.operators.coercion import as_date, as_number, present

# Name of each storage type as the profile reports it.
TYPE_NAMES = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32", "boolean": "bool", "string": "object", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing, null %, distinct, smallest value.

    Columns are stacked into (column, value) pairs and counted per pair first,
    so repeats collapse map-side and no task holds one column's values.
    """
    pairs = []
    for field in df.schema.fields:
        value = F.when(present(df, field.name), F.col(field.name).cast("string"))
        kind = TYPE_NAMES.get(field.dataType.simpleString(), field.dataType.simpleString())
        pairs.append(F.struct(F.lit(field.name).alias("column_name"), F.lit(kind).alias("dtype"), value.alias("value")))
    stacked = df.select(F.inline(F.array(*pairs)))
    counted = stacked.groupBy("column_name", "dtype", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return counted.groupBy("column_name", "dtype").agg(
        missing.cast("long").alias("missing_values"),
        (missing / F.sum("n") * 100).alias("null_percentage"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("sample_value"),
    )


def date_range(df: DataFrame, date: str) -> DataFrame:
    parsed = as_date(df, date)
    return df.agg(F.min(parsed).alias("date_range_start"), F.max(parsed).alias("date_range_end"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Copies after the first, over all columns or a subset; nulls compare equal."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def unconvertible(df: DataFrame, roles: Roles) -> DataFrame:
    """Values that exist but do not read as a date / number."""
    return df.agg(
        F.count_if(F.col(roles.date).isNotNull() & as_date(df, roles.date).isNull()).alias("invalid_date_values"),
        F.count_if(present(df, roles.target) & as_number(df, roles.target).isNull()).alias("invalid_target_values"),
    )


def key_count(df: DataFrame, roles: Roles) -> DataFrame:
    """Distinct key combinations, null combinations included; one without keys."""
    if not roles.keys:
        return df.limit(1).agg(F.lit(1).cast("long").alias("distinct_keys"))
    return df.select(*roles.keys).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))


def band(median_gap: Column) -> Column:
    label = F.lit(IRREGULAR)
    for low, high, name in reversed(FREQUENCY_BANDS):
        label = F.when(median_gap.between(low, high), name).otherwise(label)
    return label


def gap_counts(df: DataFrame, ts: Column) -> DataFrame:
    """How often each whole-day gap occurs between consecutive distinct timestamps.

    Gaps inside a calendar day are all zero days, so only per-day counts and
    bounds are needed; the ordered step then runs over calendar days, whose
    number does not grow with the data.
    """
    stamps = df.select(ts.alias("ts")).where(F.col("ts").isNotNull()).distinct()
    days = stamps.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")
    )
    before = F.lag("high").over(Window.orderBy("day"))
    across = F.struct(F.timestamp_diff("DAY", F.col("before"), F.col("low")).alias("gap"), F.lit(1).cast("long").alias("n"))
    inside = F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n"))
    gaps = days.withColumn("before", before).select(F.inline(F.array(across, inside)))
    return gaps.where("gap IS NOT NULL AND n > 0").groupBy("gap").agg(F.sum("n").alias("n"))


def frequency(df: DataFrame, date: str) -> DataFrame:
    """One row: median whole-day gap over the whole table and its grain label."""
    counts = gap_counts(df, as_date(df, date))
    # The histogram has one row per distinct day gap: bounded by the calendar.
    upto = F.sum("n").over(Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    placed = counts.withColumn("upto", upto).withColumn("total", total)
    low = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("gap")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("gap")))
    median = placed.agg(((low + high) / 2.0).alias("median_gap_days"))
    return median.withColumn("frequency", band(F.col("median_gap_days")))


# Unit of each grain's expected timeline.
PERIOD_UNIT = {"Daily": "DAY", "Weekly": "WEEK", "Monthly": "MONTH", "Quarterly": "QUARTER", "Yearly": "YEAR"}


def first_anchor(low: Column, grain: str) -> Column:
    """First expected period start at or after `low`, keeping its time of day."""
    day = low.cast("date")
    if grain == "Daily":
        return low
    if grain == "Weekly":
        moved = F.next_day(F.date_sub(day, 1), "SU")
    else:
        unit, months = {"Monthly": ("month", 1), "Quarterly": ("quarter", 3), "Yearly": ("year", 12)}[grain]
        start = F.trunc(day, unit)
        moved = F.when(start == day, day).otherwise(F.add_months(start, months))
    return F.timestamp_add("DAY", F.datediff(moved, day), low)


def expected_periods(low: Column, high: Column, grain: str) -> Column:
    first = first_anchor(low, grain)
    return F.when(first <= high, F.timestamp_diff(PERIOD_UNIT[grain], first, high) + 1).otherwise(F.lit(0))


def missing_periods(df: DataFrame, roles: Roles, grain: str | None, options: Quality = Quality()) -> DataFrame:
    """Expected minus seen periods, summed over keys; null where unknowable."""
    null_answer = F.lit(None).cast("long").alias("missing_periods")
    if not options.count_missing_periods or grain not in PERIOD_UNIT:
        return df.limit(1).agg(null_answer)
    dated = df.select(*roles.keys, as_date(df, roles.date).alias("ds")).where(F.col("ds").isNotNull())
    # Reduce to distinct (key, timestamp) first: partial aggregation absorbs hot keys.
    seen = dated.distinct().groupBy(*roles.keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("low"), F.max("ds").alias("high")
    )
    absent = F.greatest(expected_periods(F.col("low"), F.col("high"), grain) - F.col("n"), F.lit(0))
    counted = F.lit(True)
    for key in roles.keys:
        counted = counted & F.col(key).isNotNull()
    gaps = F.sum(F.when(counted & (F.col("n") >= 2), absent).otherwise(F.lit(0)))
    return seen.agg(F.when(F.count(F.lit(1)) > 0, gaps).cast("long").alias("missing_periods"))


def month_depth(df: DataFrame, roles: Roles) -> DataFrame:
    """Distinct calendar months with data per key; rows with a null key do not count."""
    month = F.date_trunc("month", as_date(df, roles.date)).cast("date")
    months = df.select(*roles.keys, month.alias("month")).dropna().distinct()
    return months.groupBy(*roles.keys).agg(F.count(F.lit(1)).alias("periods"))


def missing_share(df: DataFrame, target: str) -> DataFrame:
    """Percentage of rows whose target is absent or not a number."""
    bad = F.avg(as_number(df, target).isNull().cast("int")) * 100
    return df.agg(F.round(bad, 2).alias("missing_percentage"))


def quality_report(df: DataFrame, roles: Roles, grain: str | None, options: Quality = Quality()) -> DataFrame:
    """The one-row report the suitability verdict is read from, in one scan.

    Equal rows are counted first, then rows per (key, date as given), per (key,
    date read), per key, and in all: each aggregate works on what the one before has
    left and carries its sums, so repeats and hot keys collapse map-side.
    """
    taken = {c.lower() for c in df.columns}
    name = lambda c: c if c.lower() not in taken else name(f"{c}_")
    n, dupes, low, high = (name(c) for c in ("_n", "_dupes", "_low", "_high"))
    sums = {c: name(f"_{c}") for c in ("total_observations", "missing_target_values", "invalid_target_values", "invalid_date_values")}
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(n))
    number, parsed, there = as_number(rows, roles.target), as_date(rows, roles.date), present(rows, roles.target)
    flags = {
        "total_observations": number.isNotNull(), "missing_target_values": ~there, "invalid_target_values": there & number.isNull(),
        "invalid_date_values": F.col(roles.date).isNotNull() & parsed.isNull(),
    }
    first = lambda c: F.coalesce(F.sum(F.when(flags[c], F.col(n))), F.lit(0)).alias(sums[c])
    on = lambda *extra: [F.col(f"`{c}`") for c in (*roles.keys, *extra)]
    carried = lambda: [F.sum(n).alias(n), F.sum(dupes).alias(dupes), F.min(low).alias(low), F.max(high).alias(high), *[F.sum(c).alias(c) for c in sums.values()]]
    stamp, repeats, seen = name("_stamp"), name("_repeats"), name("_seen")
    # A column of the date as given and as read; both may repeat, one within the other.
    dated = rows.withColumn(stamp, parsed).groupBy(*on(roles.date), stamp).agg(
        F.sum(n).alias(n), F.sum(F.col(n) - 1).alias(dupes), F.min(number).alias(low), F.max(number).alias(high), *[first(c) for c in flags]
    )
    read = dated.withColumn(repeats, F.col(n) - 1).groupBy(*on(), stamp).agg(F.sum(repeats).alias(repeats), *carried())
    per_key = read.groupBy(*on()).agg(F.sum(repeats).alias(repeats), *carried(), F.count(stamp).alias(seen), F.min(stamp).alias("date_range_start"), F.max(stamp).alias("date_range_end"))
    whole = F.lit(True)
    for key in roles.keys:
        whole = whole & F.col(f"`{key}`").isNotNull()
    gaps, known = F.lit(None).cast("long"), F.lit(False)
    if options.count_missing_periods and grain in PERIOD_UNIT:
        absent = F.greatest(expected_periods(F.col("date_range_start"), F.col("date_range_end"), grain) - F.col(seen), F.lit(0))
        gaps = F.sum(F.when(whole & (F.col(seen) >= 2), absent).otherwise(F.lit(0)))
        known = F.max(seen) > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(
        total(n).alias("total_rows"), *[total(sums[c]).alias(c) for c in ("total_observations",)],
        F.coalesce(F.min(low) == F.max(high), F.lit(True)).alias("constant_target"),
        *[total(sums[c]).alias(c) for c in ("missing_target_values", "invalid_target_values", "invalid_date_values")],
        F.min("date_range_start").alias("date_range_start"), F.max("date_range_end").alias("date_range_end"),
        total(dupes).alias("duplicate_rows"), total(repeats).alias("duplicate_timestamps"),
        (F.count(F.lit(1)) if roles.keys else F.lit(1).cast("long")).alias("distinct_keys"), F.when(known, gaps).cast("long").alias("missing_periods"),
    )


def suitability(report: DataFrame, roles: Roles, options: Quality = Quality()) -> DataFrame:
    """Verdict plus reasons: what cleaning cannot repair blocks, the rest warns."""
    c = F.col
    lost = (c("invalid_target_values") + c("missing_target_values")) / F.nullif(c("total_rows"), F.lit(0))
    blocking = F.array_compact(F.array(
        F.when(c("total_observations") == 0, F.lit("no numeric target values"))
        .when(c("total_observations") < options.min_rows, F.lit("insufficient observations")),
        F.when(c("constant_target") & (c("total_observations") > 0), F.lit("constant target")),
        F.when(c("date_range_start").isNull(), F.lit("no interpretable dates")),
        F.when(lost > options.max_missing_ratio, F.lit("too many missing target values")),
    ))
    warnings = F.array_compact(F.array(
        F.when((lost > 0) & (lost <= options.max_missing_ratio), F.lit("missing target values")),
        F.when(c("duplicate_rows") > 0, F.lit("duplicate rows")),
        F.when(c("duplicate_timestamps") > 0, F.lit("repeated timestamps")),
        F.when(c("invalid_date_values") > 0, F.lit("unreadable dates")),
        F.when(c("missing_periods") > 0, F.lit("missing periods")),
    ))
    status = F.when(F.size(blocking) > 0, "Not Suitable").when(F.size(warnings) > 0, "Warnings").otherwise("Ready")
    reasons = F.when(F.size(blocking) > 0, blocking).otherwise(warnings)
    return report.withColumn("suitability", status).withColumn("reasons", reasons)

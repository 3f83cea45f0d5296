"""Row cleaning, missing-value strategies and the monthly roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keycast.config import SUB_MONTHLY, Cleaning, DataError, Roles
from keycast.functions.skew import exact_quantiles, key_struct, neighbours
from keycast.operators.coercion import coerce, is_number


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_last_per_date(df: DataFrame, roles: Roles, order: list[str]) -> DataFrame:
    """One row per (key, date): the last in the stated order.

    An aggregate, not a window: partial `max_by` leaves one row per key and
    date on each mapper, so a hot (key, date) never reaches one task whole.
    """
    by = [*roles.keys, roles.date]
    rest = [c for c in df.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(last).select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns])


def fill_missing(df: DataFrame, roles: Roles, strategy: str, order: list[str]) -> DataFrame:
    """Apply one strategy to missing targets, never across keys, then drop what it could not reach.

    `order` must give a total order of rows inside a key (date, then a unique
    column): a table has no input order to fall back on.
    """
    y = roles.target
    keys = list(roles.keys)
    if strategy == "none":
        return df
    if strategy == "drop":
        return df.dropna(subset=[y])
    if strategy == "zero":
        return df.withColumn(y, F.coalesce(F.col(y), F.lit(0.0)))
    if strategy in ("forward_fill", "backward_fill", "interpolate"):
        near = neighbours(df, keys, order, y)
        if strategy == "forward_fill":
            filled = F.col("_prev")
        elif strategy == "backward_fill":
            filled = F.col("_next")
        else:
            share = (F.col("_pos") - F.col("_prev_pos")) / F.nullif(F.col("_next_pos") - F.col("_prev_pos"), F.lit(0))
            line = F.col("_prev") + (F.col("_next") - F.col("_prev")) * share
            # A trailing gap holds the last value, a leading gap stays empty.
            filled = F.when(F.col("_next").isNull(), F.col("_prev")).otherwise(line)
        return near.withColumn(y, F.coalesce(F.col(y), filled)).select(*df.columns).dropna(subset=[y])
    if strategy == "mean":
        level = df.groupBy(*keys).agg(F.avg(y).alias("_level"))
    elif strategy == "median":
        level = exact_quantiles(df, keys, y, [0.5]).withColumnRenamed("q_0", "_level")
    else:
        raise DataError(f"Unknown missing-value strategy '{strategy}'.")
    right = level.select(key_struct(keys).alias("_key"), "_level")
    if not keys:
        right = F.broadcast(right)  # a single row
    # With keys, AQE broadcasts the level table when it is small and splits hot keys when it is not.
    joined = df.withColumn("_key", key_struct(keys)).join(right, "_key", "left")
    return joined.withColumn(y, F.coalesce(F.col(y), F.col("_level"))).select(*df.columns).dropna(subset=[y])


def should_roll_up(grain: str | None, options: Cleaning) -> bool:
    return options.roll_up and grain in SUB_MONTHLY


def _method(column: str, method: str, order: Column) -> Column:
    if method == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[method](column).alias(column)


def feature_methods(df: DataFrame, roles: Roles, options: Cleaning) -> dict[str, str]:
    """Roll-up of each feature: an override, else the mean for numbers and the last value for the rest."""
    chosen = {}
    for name in roles.features:
        default = options.default_feature_method if is_number(df.schema[name].dataType) else "last"
        chosen[name] = options.feature_methods.get(name, default)
    return chosen


def to_months(df: DataFrame, roles: Roles, options: Cleaning = Cleaning(), order: list[str] | None = None) -> DataFrame:
    """One row per key and month; columns without a role are dropped. Partial aggregation does the heavy part."""
    at = F.struct(*(order or [roles.date]))
    month = F.date_trunc("month", F.col(roles.date)).cast("date").alias("_month")
    aggregates = [_method(roles.target, roles.method, at)]
    aggregates += [_method(name, method, at) for name, method in feature_methods(df, roles, options).items()]
    rolled = df.groupBy(*roles.keys, month).agg(*aggregates)
    return rolled.withColumnRenamed("_month", roles.date)


def usable(curated: DataFrame, target: str) -> DataFrame:
    """The facts of the post-cleaning gate in one aggregate."""
    return curated.agg(
        F.count(F.lit(1)).alias("curated_rows"),
        F.coalesce(F.min(target) < F.max(target), F.lit(False)).alias("target_varies"),
    )


def assert_usable(curated: DataFrame, roles: Roles, options: Cleaning) -> None:
    facts = usable(curated, roles.target).first()
    if facts.curated_rows == 0:
        raise DataError("Cleaning removed every row. Check the date and target columns.")
    if facts.curated_rows < options.min_rows:
        raise DataError(f"Only {facts.curated_rows} rows are left after cleaning; {options.min_rows} are needed.")
    if not facts.target_varies:
        raise DataError(f"Target column '{roles.target}' is constant after cleaning.")


def prepare(df: DataFrame, roles: Roles, grain: str | None, options: Cleaning = Cleaning(), order: list[str] | None = None) -> DataFrame:
    """Dates, target, duplicates, missing values, months: the curated table."""
    roles.check(df.columns)
    order = order or [roles.date, *[c for c in df.columns if c != roles.date]]
    curated = coerce(df, roles.date, roles.target, options)
    if options.drop_duplicates:
        if options.duplicate_scope == "key_and_date":
            curated = keep_last_per_date(curated, roles, order)
        else:
            curated = drop_duplicate_rows(curated)
    curated = fill_missing(curated, roles, options.missing, order)
    return to_months(curated, roles, options, order) if should_roll_up(grain, options) else curated


def reconcile(df: DataFrame, roles: Roles, grain: str | None, options: Cleaning = Cleaning(), order: list[str] | None = None) -> DataFrame:
    """Where every input row went, one row. Each step is counted by an aggregate of its own."""
    order = order or [roles.date, *[c for c in df.columns if c != roles.date]]
    typed = coerce(df, roles.date, roles.target, options)
    unique = typed
    if options.drop_duplicates:
        by_date = options.duplicate_scope == "key_and_date"
        unique = keep_last_per_date(typed, roles, order) if by_date else drop_duplicate_rows(typed)
    filled = fill_missing(unique, roles, options.missing, order)
    rolled = to_months(filled, roles, options, order) if should_roll_up(grain, options) else filled
    counts = None
    for name, step in (("rows_read", df), ("rows_dated", typed), ("rows_unique", unique), ("rows_filled", filled), ("curated_rows", rolled)):
        one = step.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
        counts = one if counts is None else counts.join(one, "_one")
    return counts.select(
        "rows_read",
        (F.col("rows_read") - F.col("rows_dated")).alias("invalid_date_rows_removed"),
        (F.col("rows_dated") - F.col("rows_unique")).alias("duplicate_rows_removed"),
        (F.col("rows_unique") - F.col("rows_filled")).alias("missing_target_rows_removed"),
        F.col("rows_filled").alias("rows_before_roll_up"),
        "curated_rows",
        (F.col("rows_read") - F.col("curated_rows")).alias("rows_removed"),
    )


def repeated_dates(curated: DataFrame, roles: Roles) -> DataFrame:
    """(key, date) pairs held by more than one row."""
    counts = curated.groupBy(*roles.keys, roles.date).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where("copies > 1")


def verify(curated: DataFrame, roles: Roles, options: Cleaning = Cleaning()) -> None:
    """Integrity check right before training."""
    from keycast.operators.coercion import is_datetime

    if not is_datetime(curated.schema[roles.date].dataType):
        raise DataError(f"Curated column '{roles.date}' is not a date.")
    if not is_number(curated.schema[roles.target].dataType):
        raise DataError(f"Curated column '{roles.target}' is not numeric.")
    if not repeated_dates(curated, roles).isEmpty():
        raise DataError("The curated data holds more than one row for a key and date.")
    if usable(curated, roles.target).first().curated_rows < options.min_rows:
        raise DataError(f"The curated data holds fewer than {options.min_rows} rows.")

"""Checks on a role mapping before a run: four checks and one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keycast.config import COARSER_THAN_MONTHLY, SUB_MONTHLY, Roles
from keycast.functions.ranges import rows_at
from keycast.operators.coercion import as_date, as_number, is_datetime, is_number, present
from keycast.operators.profile import frequency, key_count

SAMPLE_ROWS = 200
MIN_ROWS = 12
MIN_RATIO = 0.95
CHECK = "check_name string, status string, detail string"


def even_sample(df: DataFrame, column: str, order: list[str], size: int = SAMPLE_ROWS) -> DataFrame:
    """`size` non-missing rows evenly spaced over the stated order (all rows when fewer)."""
    # Position i * last // gaps for each of the sample's places; the rows between them are counted, not sorted.
    spaced = lambda n: list(range(n)) if n <= size else [i * (n - 1) // (size - 1) for i in range(size)]
    return rows_at(df.where(present(df, column)), order, spaced).drop("_position")


def _read(df: DataFrame, column: str, reader) -> DataFrame:
    """Share of all present values that convert, and whether they differ: one map-side aggregate over the column."""
    there = df.where(present(df, column))
    raw = F.col(column)
    ratio = F.count(reader(there, column)) / F.nullif(F.count(raw), F.lit(0))
    differ = F.when(F.min(raw) < F.max(raw), 2).otherwise(F.least(F.count(raw), F.lit(1)))
    return there.agg(F.count(raw).alias("n"), ratio.alias("ratio"), differ.alias("distinct"))


def _result(name: str, table: DataFrame, status: Column, detail: Column | None = None) -> DataFrame:
    return table.select(F.lit(name).alias("check_name"), status.alias("status"), (F.lit("") if detail is None else detail).alias("detail"))


def _fixed(df: DataFrame, name: str, status: str, detail: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(name, status, detail)], CHECK)


def check_date(df: DataFrame, roles: Roles) -> DataFrame:
    name = "date-column"
    if roles.date not in df.columns:
        return _fixed(df, name, "Invalid", "column not found")
    kind = df.schema[roles.date].dataType
    if is_datetime(kind):
        return _fixed(df, name, "Valid", "stored as a datetime column")
    facts = _read(df, roles.date, as_date)
    text = isinstance(kind, T.StringType)
    status = F.when(F.lit(text) & (F.col("ratio") >= MIN_RATIO), "Convertible").otherwise("Invalid")
    detail = F.when(F.col("n") == 0, "no values").when(F.lit(not text), "numeric values").when(
        F.col("ratio") >= MIN_RATIO, "text that converts to dates"
    ).otherwise("cannot be read as dates")
    return _result(name, facts, status, detail)


def check_target(df: DataFrame, roles: Roles) -> DataFrame:
    name = "target-column"
    if roles.target not in df.columns:
        return _fixed(df, name, "Invalid", "column not found")
    kind = df.schema[roles.target].dataType
    facts = _read(df, roles.target, as_number)
    if is_datetime(kind):
        return _result(name, facts, F.lit("Invalid"), F.when(F.col("n") == 0, "no values").otherwise("datetime values"))
    if is_number(kind):
        flat = F.col("distinct") <= 1
        status = F.when(flat, "Invalid").otherwise("Valid")
        detail = F.when(F.col("n") == 0, "no values").when(flat, "constant").otherwise("numeric")
    else:
        good = F.col("ratio") >= MIN_RATIO
        status = F.when(F.coalesce(good, F.lit(False)), "Convertible").otherwise("Invalid")
        detail = F.when(F.col("n") == 0, "no values").when(good, "text that converts to numbers").otherwise("cannot be read as numbers")
    return _result(name, facts, status, detail)


def check_keys(df: DataFrame, roles: Roles) -> DataFrame:
    name = "business-keys"
    if not roles.keys:
        return _fixed(df, name, "Valid", "single series")
    if set(roles.keys) - set(df.columns):
        return _fixed(df, name, "Invalid", "key column not found")
    counted = key_count(df, roles)
    status = F.when(F.col("distinct_keys") == 0, "Invalid").otherwise("Valid")
    return _result(name, counted, status, F.format_string("%d forecasting groups", F.col("distinct_keys")))


def frequency_status(grain: Column) -> Column:
    return (
        F.when(grain.isin(*COARSER_THAN_MONTHLY), "Invalid").when(grain.isin(*SUB_MONTHLY, "Irregular", "Unknown"), "Convertible").otherwise("Valid")
    )


def check_frequency(df: DataFrame, roles: Roles) -> DataFrame:
    grain = F.col("frequency")
    return _result("frequency", frequency(df, roles.date), frequency_status(grain), grain)


def checks(df: DataFrame, roles: Roles) -> DataFrame:
    """The four checks as four rows."""
    return (
        check_date(df, roles).unionByName(check_target(df, roles))
        .unionByName(check_keys(df, roles)).unionByName(check_frequency(df, roles))
    )


def verdict(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Any Invalid check or too few rows blocks; any Convertible check warns. `rows` is one row, `total_rows`."""
    few = F.when(F.col("total_rows") < MIN_ROWS, F.lit("insufficient observations"))
    reason = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.concat_ws(": ", "check_name", "detail"))))
    summed = found.agg(reason("Invalid").alias("blocking"), reason("Convertible").alias("warnings")).withColumn("_one", F.lit(1))
    both = summed.join(rows.withColumn("_one", F.lit(1)), "_one")
    blocked = F.array_compact(F.concat(F.col("blocking"), F.array(few)))
    status = F.when(F.size(blocked) > 0, "Not Suitable").when(F.size("warnings") > 0, "Warnings").otherwise("Ready")
    reasons = F.when(F.size(blocked) > 0, blocked).otherwise(F.col("warnings"))
    return both.select(status.alias("suitability"), F.array_join(reasons, "; ").alias("reasons"))


def mapping(df: DataFrame, roles: Roles) -> DataFrame:
    """Normalised role mapping of a dataset: mode, key label, grain, key count, shape."""
    one = lambda d: d.withColumn("_one", F.lit(1))
    shape = df.agg(F.count(F.lit(1)).alias("row_count"))
    joined = one(shape).join(one(key_count(df, roles)), "_one").join(one(frequency(df, roles.date)), "_one")
    return joined.select(
        F.lit(roles.mode).alias("mode"), F.lit(roles.key_label).cast("string").alias("composite_key"),
        F.col("frequency").alias("forecast_frequency"), F.col("distinct_keys").alias("unique_keys"),
        "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
    )

"""Turning raw columns into dates and numbers, or refusing to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keycast.config import Cleaning, DataError

DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyyMMdd")
DAYFIRST_FORMATS = ("yyyy/MM/dd", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyyMMdd")


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def parse_date(raw: Column, dayfirst: bool = False) -> Column:
    """Text to a zone-less timestamp, null where no known form fits."""
    tries = [raw.try_cast("timestamp_ntz")]
    for pattern in DAYFIRST_FORMATS if dayfirst else DATE_FORMATS:
        tries.append(F.try_to_timestamp(raw, F.lit(pattern)).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def as_date(df: DataFrame, column: str, dayfirst: bool = False) -> Column:
    """Date reading of any column. Numbers and booleans never count as dates."""
    kind = df.schema[column].dataType
    if is_datetime(kind):
        return F.col(column).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return parse_date(F.col(column), dayfirst)
    return F.lit(None).cast("timestamp_ntz")


def as_number(df: DataFrame, column: str) -> Column:
    """Numeric reading of any column; NaN and text that is no number are null."""
    kind = df.schema[column].dataType
    if is_datetime(kind):
        return F.lit(None).cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("int").cast("double")
    number = F.col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def present(df: DataFrame, column: str) -> Column:
    """Not missing: neither null nor, for a float column, NaN."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def parse_ratios(df: DataFrame, date: str, target: str, dayfirst: bool = False) -> DataFrame:
    """One row: how many date and target values exist and how many convert. One scan."""
    return df.agg(
        F.count_if(F.col(date).isNotNull()).alias("date_present"),
        F.count_if(F.col(date).isNotNull() & as_date(df, date, dayfirst).isNotNull()).alias("date_parsed"),
        F.count_if(present(df, target)).alias("target_present"),
        F.count_if(as_number(df, target).isNotNull()).alias("target_parsed"),
    )


def coerce(df: DataFrame, date: str, target: str, options: Cleaning) -> DataFrame:
    """Typed date and target columns; a column that mostly fails to convert stops the run.

    Columns that already have the right type cost nothing: the gate (one
    aggregate over both columns) runs only when something has to be parsed.
    """
    date_kind, target_kind = df.schema[date].dataType, df.schema[target].dataType
    text_date, text_target = not is_datetime(date_kind), not is_number(target_kind)
    if text_date and not options.convert_date:
        raise DataError(f"Date column '{date}' is not a datetime column and conversion is disabled.")
    if text_date and not isinstance(date_kind, T.StringType):
        raise DataError(f"Date column '{date}' holds numeric values and cannot be read as dates.")
    if is_datetime(target_kind):
        raise DataError(f"Target column '{target}' holds dates and cannot be forecast.")
    if text_target and not options.convert_target:
        raise DataError(f"Target column '{target}' is not numeric and conversion is disabled.")
    if text_date or text_target:
        ratios = parse_ratios(df, date, target, options.dayfirst).first()
        for name, wanted, have, got in (
            (date, text_date, ratios.date_present, ratios.date_parsed),
            (target, text_target, ratios.target_present, ratios.target_parsed),
        ):
            if wanted and have == 0:
                raise DataError(f"Column '{name}' contains no values.")
            if wanted and got / have < options.min_parse_ratio:
                raise DataError(f"Column '{name}': only {got / have:.1%} of values could be converted.")
    typed = df.withColumn(date, as_date(df, date, options.dayfirst))
    if text_date and options.drop_unparsed_dates:
        typed = typed.where(F.col(date).isNotNull())
    return typed.withColumn(target, as_number(df, target))

"""Reading the input table and writing what a run produces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from keycast.functions.ranges import rows_at
from keycast.functions.text import safe_key

READABLE = (".csv", ".parquet")
EXPORT_COLUMNS = ("group_id", "model_name", "date", "value", "lower", "upper")


class DatasetError(ValueError):
    """The dataset cannot be loaded, with the reason a user can act on."""


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV or parquet by suffix. Give `schema` at scale: inference reads a CSV twice."""
    suffix = path[path.rfind("."):].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in READABLE:
        raise DatasetError(f"Unsupported file format '{suffix}'. Supported formats are: {', '.join(READABLE)}.")
    try:
        if suffix == ".csv":
            reader = spark.read.option("header", True).option("inferSchema", schema is None)
            table = (reader.schema(schema) if schema is not None else reader).csv(path)
        else:
            table = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
        empty = not table.columns or table.isEmpty()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise DatasetError(f"Dataset '{path}' could not be found.") from problem
        raise DatasetError(f"Failed to read '{path}': {problem}") from problem
    if empty:
        raise DatasetError(f"Dataset '{path}' is empty.")
    return table


def write_curated(curated: DataFrame, root: str, run_id: str, source_name: str, file_format: str = "parquet") -> str:
    """`<root>/<run_id>/curated_<stem>.<format>`, one directory written by all executors."""
    if file_format not in ("csv", "parquet"):
        raise DatasetError(f"Unsupported curated format '{file_format}'.")
    stem = source_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    path = f"{root}/{run_id}/curated_{stem}.{file_format}"
    writer = curated.write.mode("overwrite")
    writer.option("header", True).csv(path) if file_format == "csv" else writer.parquet(path)
    return path


def forecast_rows(forecasts: DataFrame, winners: DataFrame) -> DataFrame:
    """One flat row per (winner, date); groups without a forecast give no row."""
    kept = forecasts.join(winners.select("group_id", "model_name"), ["group_id", "model_name"], "left_semi")
    return kept.select("group_id", "model_name", F.col("ds").alias("date"), "value", "lower", "upper")


def write_forecasts(rows: DataFrame, root: str, run_id: str) -> str:
    path = f"{root}/{safe_run_id(run_id)}_forecast.csv"
    rows.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def safe_run_id(run_id: str) -> str:
    """Driver-side twin of `safe_key` for the one name used in a path."""
    import re

    cleaned = re.sub(r"\.{2,}", "_", re.sub(r"[^A-Za-z0-9_.-]+", "_", run_id)).strip("_.")
    return cleaned or "key"


def write_mirror(insights: DataFrame, calls: DataFrame, root: str) -> list[str]:
    """JSON copies partitioned by run; the call trace only if it holds calls."""
    written = [f"{root}/business_insights"]
    insights.write.mode("overwrite").partitionBy("run_id").json(written[0])
    if not calls.isEmpty():
        written.append(f"{root}/call_trace")
        calls.write.mode("overwrite").partitionBy("run_id").json(written[-1])
    return written


def same_key(table: DataFrame, column: str, value) -> Column:
    """Key equality that accepts '1', 1 and 1.0 as the same key.

    A number column is compared with a literal of its own type, so the filter
    reaches the scan and prunes row groups.
    """
    kind = table.schema[column].dataType
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    if isinstance(kind, T.IntegralType):
        return F.col(column) == F.lit(int(number)).cast(kind) if number is not None and number.is_integer() else F.lit(False)
    if isinstance(kind, T.FractionalType):
        return F.col(column) == F.lit(number).cast(kind) if number is not None else F.lit(False)
    text = F.col(column).cast("string") == F.lit(str(value))
    return text if number is None else F.coalesce(F.col(column).try_cast("double") == F.lit(number), text)


def full_series(curated: DataFrame, date: str, target: str, key_values: dict | None = None) -> DataFrame:
    """One key's whole curated series in date order."""
    kept = curated
    for column, value in (key_values or {}).items():
        kept = kept.where(same_key(kept, column, value))
    y = F.col(target).try_cast("double")
    ds = F.col(date).try_cast("date")
    return kept.select(ds.alias("ds"), y.alias("y")).where(ds.isNotNull() & y.isNotNull() & ~F.isnan(y)).orderBy("ds", "y")


def page(curated: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of one page in the stated order; ties are broken by all other columns, so pages never overlap.

    A page reads its own ranges of the order, which are found by counting;
    nothing sorts, skips or writes the whole table, however deep the page.
    """
    number, size = max(number, 1), max(1, size)
    start = (number - 1) * size
    whole = curated.withColumn("_tie", F.xxhash64(*curated.columns))
    placed = rows_at(whole, [*order, "_tie"], lambda n: list(range(start, min(n, start + size))))
    return placed.orderBy("_position").select(*curated.columns)


def page_totals(curated: DataFrame, size: int) -> DataFrame:
    size = max(1, size)
    total = curated.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / F.lit(size))).cast("long"))


# Tracking-store status → run status.
# An unfinished state of a listed run means its process died without an outcome.
RUN_STATUS = {"FINISHED": "Completed", "FAILED": "Failed", "KILLED": "Cancelled", "RUNNING": "Failed", "SCHEDULED": "Failed"}


def run_listing(runs: DataFrame, limit: int | None) -> DataFrame:
    """Newest runs first, with a mapped status and a duration never below zero; all of them without a limit."""
    from keycast.functions.skew import small_map

    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at")) / 1e6
    listed = (
        runs.select(
            "run_id",
            "started_at",
            F.coalesce(F.try_element_at(small_map(RUN_STATUS), F.col("state")), F.lit("Failed")).alias("status"),
            F.greatest(seconds, F.lit(0.0)).alias("duration_seconds"),
        )
        .orderBy(F.desc("started_at"), "run_id")
    )
    return listed if limit is None else listed.limit(limit)

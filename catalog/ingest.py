"""Sources, coercion, validation and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import EVENT_ROLES, TEXT_EVENTS, TEXT_ROLES, folder, gappy_events, GAPPY, table, text_events, with_
from keycast.config import Cleaning, Quality, Roles
from keycast.operators import coercion, profile, validation
from keycast.sources import tables

ORDER_ROLES = Roles("o_orderdate", "o_totalprice", ("o_orderstatus",))


def _rows(df, *columns):
    return df.select(*columns)


for _format in ("csv", "parquet"):
    @query(f"source_{_format}_round_trip", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
    def _(spark, sf, file_format=_format):
        rows = table(spark, sf, "customer")
        path = tables.write_curated(rows, folder(spark, "curated"), "run-1", "customer.csv", file_format)
        back = tables.load_table(spark, path, rows.schema if file_format == "csv" else None)
        return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("source_csv_inferred_schema", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(spark, sf):
    path = tables.write_curated(table(spark, sf, "nation"), folder(spark, "curated"), "run-1", "nation.parquet", "csv")
    back = tables.load_table(spark, path)
    return back.select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("source_one_key_series", """SELECT CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    return tables.full_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", {"o_orderstatus": "P"})


@query("source_numeric_key_series", "SELECT CAST(ts AS DATE) AS ds, value AS y FROM events WHERE user_id = 7 AND value IS NOT NULL")
def _(spark, sf):
    return tables.full_series(table(spark, sf, "events"), "ts", "value", {"user_id": "7.0"})


_PAGE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_orderdate, o_orderkey LIMIT 50 OFFSET 100"


@query("source_page", _PAGE)
def _(spark, sf):
    page = tables.page(table(spark, sf, "orders"), ["o_orderstatus", "o_orderdate", "o_orderkey"], 3, 50)
    return page.select("o_orderkey", "o_totalprice")


@query("source_page_totals", "SELECT count(*) AS total_rows, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS total_pages FROM orders")
def _(spark, sf):
    return tables.page_totals(table(spark, sf, "orders"), 50)


@query("source_global_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderdate, o_orderkey) - 1 AS position FROM orders")
def _(spark, sf):
    from keycast.functions.skew import global_positions

    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return global_positions(rows, ["o_orderstatus", "o_orderdate", "o_orderkey"]).select("o_orderkey", "position")


# -- coercion -------------------------------------------------------------------


@query("coerce_dates", with_(TEXT_EVENTS) + "SELECT event_id, CAST(try_cast(ts_text AS TIMESTAMP) AS DATE) AS d FROM text_events WHERE try_cast(ts_text AS TIMESTAMP) IS NOT NULL")
def _(spark, sf):
    typed = coercion.coerce(text_events(spark, sf), "ts_text", "value_text", Cleaning())
    return typed.select("event_id", F.col("ts_text").cast("date").alias("d"))


@query("coerce_targets", with_(TEXT_EVENTS) + "SELECT event_id, round(try_cast(value_text AS DOUBLE), 6) AS y FROM text_events WHERE try_cast(ts_text AS TIMESTAMP) IS NOT NULL")
def _(spark, sf):
    typed = coercion.coerce(text_events(spark, sf), "ts_text", "value_text", Cleaning())
    return typed.select("event_id", F.round("value_text", 6).alias("y"))


@query("coerce_ratios", with_(TEXT_EVENTS) + """SELECT count(ts_text) AS date_present, count(try_cast(ts_text AS TIMESTAMP)) AS date_parsed,
    count(value_text) AS target_present, count(try_cast(value_text AS DOUBLE)) AS target_parsed FROM text_events""")
def _(spark, sf):
    return coercion.parse_ratios(text_events(spark, sf), "ts_text", "value_text")


@query("coerce_to_day_formats", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS dayfirst FROM orders")
def _(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dayfirst")
    )
    return raw.select("o_orderkey", coercion.parse_date(F.col("us")).cast("date").alias("us"), coercion.parse_date(F.col("dayfirst"), True).cast("date").alias("dayfirst"))


# -- validation -------------------------------------------------------------------

_SAMPLE = """ordered AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM text_events WHERE {c} IS NOT NULL),
picks AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 199.0) AS BIGINT) AS pos FROM (SELECT DISTINCT n FROM ordered), range(200) r(i)),
sample AS (SELECT o.* FROM ordered o JOIN picks USING (pos))"""


@query("validate_even_sample", with_(TEXT_EVENTS, _SAMPLE.format(c="value_text")) + "SELECT event_id, value_text FROM sample")
def _(spark, sf):
    return validation.even_sample(text_events(spark, sf), "value_text", ["event_id"]).select("event_id", "value_text")


@query("validate_date_column", with_(TEXT_EVENTS) + """SELECT 'date-column' AS check_name,
    CASE WHEN count(try_cast(ts_text AS TIMESTAMP)) >= 0.95 * count(*) THEN 'Convertible' ELSE 'Invalid' END AS status FROM text_events WHERE ts_text IS NOT NULL
    UNION ALL SELECT 'date-column', 'Valid' UNION ALL SELECT 'date-column', 'Invalid'""")
def _(spark, sf):
    rows, orders = text_events(spark, sf), table(spark, sf, "orders")
    text = validation.check_date(rows, TEXT_ROLES)
    good = validation.check_date(orders, ORDER_ROLES)
    number = validation.check_date(orders, Roles("o_totalprice", "o_custkey"))
    return text.unionByName(good).unionByName(number).select("check_name", "status")


@query("validate_target_column", with_(TEXT_EVENTS) + """SELECT 'target-column' AS check_name,
    CASE WHEN count(try_cast(value_text AS DOUBLE)) >= 0.95 * count(*) THEN 'Convertible' ELSE 'Invalid' END AS status FROM text_events WHERE value_text IS NOT NULL
    UNION ALL SELECT 'target-column', 'Valid' UNION ALL SELECT 'target-column', 'Invalid' UNION ALL SELECT 'target-column', 'Invalid'""")
def _(spark, sf):
    rows, orders = text_events(spark, sf), table(spark, sf, "orders")
    out = validation.check_target(rows, TEXT_ROLES)
    for target in ("o_totalprice", "o_orderdate", "o_orderpriority"):
        out = out.unionByName(validation.check_target(orders, Roles("o_orderdate", target)))
    return out.select("check_name", "status")


@query("validate_business_keys", """SELECT 'business-keys' AS check_name, 'Valid' AS status, count(DISTINCT o_orderstatus) || ' forecasting groups' AS detail FROM orders
    UNION ALL SELECT 'business-keys', 'Valid', 'single series'""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return validation.check_keys(orders, ORDER_ROLES).unionByName(validation.check_keys(orders, Roles("o_orderdate", "o_totalprice")))


def _gaps(source, column):
    return f"""stamps AS (SELECT DISTINCT {column} AS ts FROM {source} WHERE {column} IS NOT NULL),
gaps AS (SELECT date_sub('day', lag(ts) OVER (ORDER BY ts), ts) AS g FROM stamps),
grain AS (SELECT median(g) AS median_gap_days, CASE WHEN median(g) BETWEEN 0 AND 1 THEN 'Daily' WHEN median(g) BETWEEN 2 AND 9 THEN 'Weekly'
    WHEN median(g) BETWEEN 10 AND 45 THEN 'Monthly' WHEN median(g) BETWEEN 46 AND 135 THEN 'Quarterly'
    WHEN median(g) BETWEEN 136 AND 400 THEN 'Yearly' ELSE 'Irregular' END AS frequency FROM gaps WHERE g IS NOT NULL)"""


@query("validate_frequency", with_(_gaps("orders", "o_orderdate")) + """SELECT 'frequency' AS check_name, CASE WHEN frequency IN ('Quarterly', 'Yearly') THEN 'Invalid'
    WHEN frequency = 'Monthly' THEN 'Valid' ELSE 'Convertible' END AS status, frequency AS detail FROM grain""")
def _(spark, sf):
    return validation.check_frequency(table(spark, sf, "orders"), ORDER_ROLES)


@query("validate_verdict", with_(_gaps("orders", "o_orderdate")) + """SELECT CASE WHEN n < 12 OR frequency IN ('Quarterly', 'Yearly') THEN 'Not Suitable' WHEN frequency = 'Monthly' THEN 'Ready' ELSE 'Warnings' END AS suitability,
    CASE WHEN n < 12 THEN 'insufficient observations' WHEN frequency = 'Monthly' THEN '' ELSE 'frequency: ' || frequency END AS reasons FROM grain, (SELECT count(*) AS n FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    found = validation.checks(orders, ORDER_ROLES)
    return validation.verdict(found, orders.agg(F.count(F.lit(1)).alias("total_rows")))


@query("validate_mapping", with_(_gaps("orders", "o_orderdate")) + """SELECT 'Multi Series' AS mode, 'o_orderstatus' AS composite_key, frequency AS forecast_frequency,
    (SELECT count(DISTINCT o_orderstatus) FROM orders) AS unique_keys, (SELECT count(*) FROM orders) AS row_count, CAST(6 AS BIGINT) AS column_count FROM grain""")
def _(spark, sf):
    return validation.mapping(table(spark, sf, "orders"), ORDER_ROLES)


# -- profiling ---------------------------------------------------------------------

_TYPES = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderdate": "datetime64[ns]", "o_orderpriority": "object"}
_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS missing_values, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage,
    count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS sample_value FROM orders""" for c, k in _TYPES.items())


@query("profile_columns", _PROFILE)
def _(spark, sf):
    return profile.column_profile(table(spark, sf, "orders")).withColumn("null_percentage", F.round("null_percentage", 6))


@query("profile_gappy_columns", with_(GAPPY) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_values, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage, count(DISTINCT {c}) AS distinct_values FROM gappy"
    for c in ("event_id", "ts", "user_id", "event_type", "value")))
def _(spark, sf):
    found = profile.column_profile(gappy_events(spark, sf))
    return found.select("column_name", "missing_values", F.round("null_percentage", 6).alias("null_percentage"), "distinct_values")


@query("profile_date_range", with_(TEXT_EVENTS) + "SELECT min(try_cast(ts_text AS TIMESTAMP)) AS date_range_start, max(try_cast(ts_text AS TIMESTAMP)) AS date_range_end FROM text_events")
def _(spark, sf):
    return profile.date_range(text_events(spark, sf), "ts_text")


_COPIES = "copies AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders)"


@query("profile_duplicate_rows", with_(_COPIES) + "SELECT (SELECT count(*) FROM copies) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS duplicates")
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("profile_duplicate_timestamps", "SELECT count(*) - count(DISTINCT (o_orderstatus, o_orderdate)) AS duplicates FROM orders")
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "orders"), ["o_orderstatus", "o_orderdate"])


@query("profile_unconvertible", with_(TEXT_EVENTS) + """SELECT count(*) FILTER (ts_text IS NOT NULL AND try_cast(ts_text AS TIMESTAMP) IS NULL) AS invalid_date_values,
    count(*) FILTER (value_text IS NOT NULL AND try_cast(value_text AS DOUBLE) IS NULL) AS invalid_target_values FROM text_events""")
def _(spark, sf):
    return profile.unconvertible(text_events(spark, sf), TEXT_ROLES)


@query("profile_key_count", "SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def _(spark, sf):
    return profile.key_count(table(spark, sf, "customer"), Roles("d", "v", ("c_nationkey", "c_mktsegment")))


@query("profile_frequency", with_(_gaps("orders", "o_orderdate")) + "SELECT median_gap_days, frequency FROM grain")
def _(spark, sf):
    return profile.frequency(table(spark, sf, "orders"), "o_orderdate")


@query("profile_frequency_by_event_time", with_(_gaps("events", "ts")) + "SELECT median_gap_days, frequency FROM grain")
def _(spark, sf):
    return profile.frequency(table(spark, sf, "events"), "ts")


_ANCHORS = {
    "Daily": ("day", "low"),
    "Weekly": ("week", "low + to_days(CAST((7 - dayofweek(low)) % 7 AS INTEGER))"),
    "Monthly": ("month", "CASE WHEN day(low) = 1 THEN low ELSE low + (date_trunc('month', low) + INTERVAL 1 MONTH - date_trunc('day', low)) END"),
    "Quarterly": ("quarter", "CASE WHEN date_trunc('quarter', low) = date_trunc('day', low) THEN low ELSE low + (date_trunc('quarter', low) + INTERVAL 3 MONTH - date_trunc('day', low)) END"),
    "Yearly": ("year", "CASE WHEN date_trunc('year', low) = date_trunc('day', low) THEN low ELSE low + (date_trunc('year', low) + INTERVAL 12 MONTH - date_trunc('day', low)) END"),
}


def _missing(grain):
    unit, first = _ANCHORS[grain]
    return f"""SELECT '{grain}' AS grain, CAST(sum(CASE WHEN n < 2 THEN 0 ELSE greatest(0, CASE WHEN f <= high THEN date_sub('{unit}', f, high) + 1 ELSE 0 END - n) END) AS BIGINT) AS missing_periods
    FROM (SELECT *, {first} AS f FROM seen)"""


@query("profile_missing_periods", with_("seen AS (SELECT o_custkey, count(DISTINCT o_orderdate) AS n, min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders GROUP BY 1)") + " UNION ALL ".join(map(_missing, _ANCHORS)))
def _(spark, sf):
    roles = Roles("o_orderdate", "o_totalprice", ("o_custkey",))
    out = None
    for grain in _ANCHORS:
        part = profile.missing_periods(table(spark, sf, "orders"), roles, grain).select(F.lit(grain).alias("grain"), "missing_periods")
        out = part if out is None else out.unionByName(part)
    return out


@query("profile_month_depth", "SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS periods FROM orders GROUP BY 1")
def _(spark, sf):
    return profile.month_depth(table(spark, sf, "orders"), Roles("o_orderdate", "o_totalprice", ("o_custkey",)))


@query("profile_missing_share", with_(TEXT_EVENTS) + "SELECT round(avg(CASE WHEN try_cast(value_text AS DOUBLE) IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_percentage FROM text_events")
def _(spark, sf):
    return profile.missing_share(text_events(spark, sf), "value_text")


_REPORT = """report AS (SELECT count(*) AS total_rows, count(value) AS total_observations, coalesce(min(value) = max(value), true) AS constant_target,
    count(*) - count(value) AS missing_target_values, min(ts) AS date_range_start, count(*) - count(DISTINCT (event_type, ts)) AS duplicate_timestamps,
    count(DISTINCT event_type) AS distinct_keys FROM gappy),
seen AS (SELECT event_type, count(DISTINCT ts) AS n, min(ts) AS low, max(ts) AS high FROM gappy GROUP BY 1),
missing AS (SELECT CAST(sum(greatest(0, date_sub('day', low, high) + 1 - n)) AS BIGINT) AS missing_periods FROM seen)"""


@query("profile_quality_report", with_(GAPPY, _REPORT) + """SELECT total_rows, total_observations, constant_target, missing_target_values, CAST(0 AS BIGINT) AS duplicate_rows,
    duplicate_timestamps, distinct_keys, missing_periods FROM report, missing""")
def _(spark, sf):
    report = profile.quality_report(gappy_events(spark, sf), EVENT_ROLES, "Daily")
    return report.select("total_rows", "total_observations", "constant_target", "missing_target_values", "duplicate_rows", "duplicate_timestamps", "distinct_keys", "missing_periods")


@query("profile_suitability", with_(GAPPY, _REPORT) + """SELECT CASE WHEN missing_target_values * 1.0 / total_rows > 0.10 THEN 'Not Suitable' ELSE 'Warnings' END AS suitability,
    CASE WHEN missing_target_values * 1.0 / total_rows > 0.10 THEN 'too many missing target values' ELSE 'missing target values' END AS reasons FROM report""")
def _(spark, sf):
    report = profile.quality_report(gappy_events(spark, sf), EVENT_ROLES, "Daily")
    return profile.suitability(report, EVENT_ROLES).select("suitability", F.array_join("reasons", "; ").alias("reasons"))

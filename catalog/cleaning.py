"""Row cleaning, roll-up, grouping and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.fixtures import GAPPY, SERIES, SUPPLIER_ROLES, USER_ROLES, gappy_events, supplier_months, supplier_series, table, with_
from keycast.config import Cleaning, Roles
from keycast.operators import clean, features
from keycast.operators import series as series_ops

ORDER = ["ts", "event_id"]


@query("clean_exact_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    return clean.drop_duplicate_rows(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("clean_last_per_key_and_date", """SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
    PARTITION BY o_orderstatus, o_orderdate ORDER BY o_orderkey DESC) AS rk FROM orders) WHERE rk = 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return clean.keep_last_per_date(rows, Roles("o_orderdate", "o_totalprice", ("o_orderstatus",)), ["o_orderkey"])


_BY = "PARTITION BY user_id ORDER BY ts, event_id"
_PREV = f"last_value(value IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = f"first_value(value IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_AT = "pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM gappy)"
_LINE = _AT + f""", near AS (SELECT *, {_PREV} AS v0, {_NEXT} AS v1,
    max(CASE WHEN value IS NOT NULL THEN p END) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
    min(CASE WHEN value IS NOT NULL THEN p END) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM pos)"""
_FILLS = {
    "none": "SELECT event_id, value AS y FROM gappy",
    "drop": "SELECT event_id, value AS y FROM gappy WHERE value IS NOT NULL",
    "zero": "SELECT event_id, coalesce(value, 0) AS y FROM gappy",
    "forward_fill": f"SELECT * FROM (SELECT event_id, coalesce(value, {_PREV}) AS y FROM gappy) WHERE y IS NOT NULL",
    "backward_fill": f"SELECT * FROM (SELECT event_id, coalesce(value, {_NEXT}) AS y FROM gappy) WHERE y IS NOT NULL",
    "interpolate": """SELECT * FROM (SELECT event_id, CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0
        ELSE v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0) END AS y FROM near) WHERE y IS NOT NULL""",
    "mean": "SELECT * FROM (SELECT event_id, coalesce(value, avg(value) OVER (PARTITION BY user_id)) AS y FROM gappy) WHERE y IS NOT NULL",
    "median": "SELECT * FROM (SELECT event_id, coalesce(value, median(value) OVER (PARTITION BY user_id)) AS y FROM gappy) WHERE y IS NOT NULL",
}
for _name, _sql in _FILLS.items():
    @query(f"clean_missing_{_name}", with_(GAPPY, _LINE) + f"SELECT event_id, round(y, 6) AS y FROM ({_sql})")
    def _(spark, sf, strategy=_name):
        filled = clean.fill_missing(gappy_events(spark, sf), USER_ROLES, strategy, ORDER)
        return filled.select("event_id", F.round("value", 6).alias("y"))


@query("clean_missing_median_single_series", with_(GAPPY) + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM gappy)), 6) AS y FROM gappy")
def _(spark, sf):
    filled = clean.fill_missing(gappy_events(spark, sf), Roles("ts", "value"), "median", ORDER)
    return filled.select("event_id", F.round("value", 6).alias("y"))


for _method, _agg in {"sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "last": "max_by(o_totalprice, (o_orderdate, o_orderkey))"}.items():
    @query(f"clean_monthly_{_method}", f"SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate, round({_agg}, 2) AS y FROM orders GROUP BY 1, 2")
    def _(spark, sf, method=_method):
        roles = Roles("o_orderdate", "o_totalprice", ("o_orderstatus",), method=method)
        rolled = clean.to_months(table(spark, sf, "orders"), roles, order=["o_orderdate", "o_orderkey"])
        return rolled.select("o_orderstatus", "o_orderdate", F.round("o_totalprice", 2).alias("y"))


@query("clean_monthly_features", """SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS l_shipdate, round(sum(l_extendedprice), 2) AS l_extendedprice,
    round(avg(l_discount), 6) AS l_discount, round(sum(l_quantity), 6) AS l_quantity,
    max_by(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_returnflag FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    roles = Roles("l_shipdate", "l_extendedprice", ("l_suppkey",), ("l_discount", "l_quantity", "l_returnflag"))
    options = Cleaning(feature_methods={"l_quantity": "sum"})
    rolled = clean.to_months(table(spark, sf, "lineitem"), roles, options, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return rolled.select("l_suppkey", "l_shipdate", F.round("l_extendedprice", 2).alias("l_extendedprice"), F.round("l_discount", 6).alias("l_discount"), F.round("l_quantity", 6).alias("l_quantity"), "l_returnflag")


@query("clean_reconciliation", with_(GAPPY) + """SELECT count(*) AS rows_read, CAST(0 AS BIGINT) AS invalid_date_rows_removed, CAST(0 AS BIGINT) AS duplicate_rows_removed,
    count(*) - count(value) AS missing_target_rows_removed, count(value) AS rows_before_roll_up,
    (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('month', ts) FROM gappy WHERE value IS NOT NULL)) AS curated_rows,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('month', ts) FROM gappy WHERE value IS NOT NULL)) AS rows_removed FROM gappy""")
def _(spark, sf):
    return clean.reconcile(gappy_events(spark, sf), USER_ROLES, "Daily", order=ORDER)


@query("clean_curated_table", with_(GAPPY) + """SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS ts, round(sum(value), 6) AS value FROM gappy WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    curated = clean.prepare(gappy_events(spark, sf), USER_ROLES, "Daily", order=ORDER)
    return curated.select("user_id", "ts", F.round("value", 6).alias("value"))


@query("clean_usable_facts", with_(SERIES) + "SELECT count(*) AS curated_rows, min(y) < max(y) AS target_varies FROM months")
def _(spark, sf):
    return clean.usable(supplier_months(spark, sf), "revenue")


@query("clean_repeated_dates", "SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    found = clean.repeated_dates(table(spark, sf, "orders"), Roles("o_orderdate", "o_totalprice", ("o_orderstatus",)))
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


# -- groups and series ---------------------------------------------------------------


@query("group_composite_keys", """SELECT c_nationkey || ' | ' || c_mktsegment AS group_id, count(*) AS rows_in_group FROM customer
    WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    roles = Roles("d", "v", ("c_nationkey", "c_mktsegment"))
    return series_ops.grouped(table(spark, sf, "customer"), roles).groupBy("group_id").agg(F.count(F.lit(1)).alias("rows_in_group"))


_TOTAL = """total AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)"""


@query("group_single_series", with_(_TOTAL) + "SELECT '__single_series__' AS group_id, row_number() OVER (ORDER BY ds) - 1 AS t, ds, y FROM total")
def _(spark, sf):
    roles = Roles("o_orderdate", "o_totalprice")
    months = clean.to_months(table(spark, sf, "orders"), roles).withColumn("o_totalprice", F.round("o_totalprice", 2))
    series = series_ops.build_series(months, roles)
    return series.select("group_id", F.col("t").cast("long").alias("t"), "ds", "y")


@query("group_drop_thin", """WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS ds FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS group_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, sf):
    roles = Roles("o_orderdate", "o_totalprice", ("o_custkey",))
    months = clean.to_months(table(spark, sf, "orders"), roles)
    kept = series_ops.build_series(months, roles, Cleaning(drop_thin_groups=True, min_rows_per_group=10))
    return kept.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query("series_projection", with_(SERIES) + "SELECT group_id, t, n, ds, y FROM series")
def _(spark, sf):
    return supplier_series(spark, sf).select("group_id", F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"), "ds", "y")


@query("series_facts", with_(SERIES) + "SELECT group_id, count(*) AS observation_count, min(ds) AS start_date, max(ds) AS end_date, count(*) >= 24 AS meets_minimum FROM series GROUP BY 1")
def _(spark, sf):
    return series_ops.series_facts(supplier_series(spark, sf))


@query("series_recent_history", with_(SERIES) + "SELECT group_id, ds, y FROM series WHERE t >= n - 24")
def _(spark, sf):
    return series_ops.recent_history(supplier_series(spark, sf)).select("group_id", "ds", "y")


@query("series_path_safe_key", r"""SELECT c_name || ' / ../' || c_mktsegment AS raw, coalesce(nullif(trim(regexp_replace(regexp_replace(c_name || ' / ../' || c_mktsegment,
    '[^A-Za-z0-9_.-]+', '_', 'g'), '\.{2,}', '_', 'g'), '_.'), ''), 'key') AS safe FROM customer""")
def _(spark, sf):
    from keycast.functions.text import safe_key

    raw = F.concat_ws(" / ../", "c_name", "c_mktsegment")
    return table(spark, sf, "customer").select(raw.alias("raw"), safe_key(raw).alias("safe"))


@query("series_key_label", "SELECT c_custkey, 'nation=' || c_nationkey || ' · segment=' || c_mktsegment AS label FROM customer")
def _(spark, sf):
    from keycast.functions.text import key_label

    values = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", key_label(values).alias("label"))


# -- derived features ----------------------------------------------------------------

_W = "PARTITION BY group_id ORDER BY t"
_DERIVED = "derived AS (SELECT group_id, t, n, ds, y, " + ", ".join(
    [f"lag(y, {k}) OVER ({_W}) AS lag_{k}" for k in (1, 2, 3, 12)]
    + [f"CASE WHEN t >= {k} THEN avg(y) OVER ({_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS rolling_mean_{k}" for k in (3, 6)]
    + ["month(ds) AS month", "quarter(ds) AS quarter", f"y - lag(y) OVER ({_W}) AS label"]) + " FROM series)"
_FEATURES = [f"lag_{k}" for k in (1, 2, 3, 12)] + ["rolling_mean_3", "rolling_mean_6"]


def _rounded(names):
    return [F.round(c, 5).alias(c) for c in names]


@query("features_lags_and_means", with_(SERIES, _DERIVED) + "SELECT group_id, t, " + ", ".join(f"round({c}, 5) AS {c}" for c in _FEATURES) + ", month, quarter FROM derived")
def _(spark, sf):
    out = features.derived(supplier_series(spark, sf), ["group_id"], ["t"], "y", "ds")
    return out.select("group_id", F.col("t").cast("long").alias("t"), *_rounded(_FEATURES), F.col("month").cast("long").alias("month"), F.col("quarter").cast("long").alias("quarter"))


@query("features_curated_preview", """WITH m AS (SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_nationkey, month_start, total, lag(total, 1) OVER w AS lag_1, CASE WHEN row_number() OVER w > 3 THEN round(avg(total) OVER (PARTITION BY c_nationkey ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) END AS rolling_mean_3,
    month(month_start) AS month FROM m WINDOW w AS (PARTITION BY c_nationkey ORDER BY month_start)""")
def _(spark, sf):
    nations = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    months = clean.to_months(orders, Roles("o_orderdate", "o_totalprice", ("c_nationkey",)))
    curated = months.select("c_nationkey", F.col("o_orderdate").alias("month_start"), F.round("o_totalprice", 2).alias("total"))
    spec = {"lags": [1], "rolling_windows": [3], "calendar_features": ["month"]}
    out = features.derived(curated, ["c_nationkey"], ["month_start"], "total", "month_start", spec)
    return out.withColumn("rolling_mean_3", F.round("rolling_mean_3", 4)).withColumn("month", F.col("month").cast("long"))


@query("features_design_matrix", with_(SERIES, _DERIVED) + "SELECT group_id, CAST(t AS DOUBLE) AS time_index, round(label, 4) AS label, " + ", ".join(f"round({c}, 5) AS {c}" for c in _FEATURES) + " FROM derived WHERE t >= 12")
def _(spark, sf):
    out = features.design_matrix(supplier_series(spark, sf), ["group_id"])
    return out.select("group_id", "time_index", F.round("label", 4).alias("label"), *_rounded(_FEATURES))


@query("features_short_history_spans", """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
    s AS (SELECT CAST(o_custkey AS VARCHAR) AS group_id, ds, y, row_number() OVER (PARTITION BY o_custkey ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY o_custkey) AS n FROM m),
    need AS (SELECT *, greatest(CASE WHEN n - 12 >= 8 THEN 12 WHEN n - 3 >= 8 THEN 3 WHEN n - 2 >= 8 THEN 2 ELSE 1 END, CASE WHEN n - 6 >= 8 THEN 6 WHEN n - 3 >= 8 THEN 3 ELSE 0 END, 1) AS span FROM s)
    SELECT group_id, t FROM need WHERE t >= span OR n <= span""")
def _(spark, sf):
    roles = Roles("o_orderdate", "o_totalprice", ("o_custkey",))
    series = series_ops.build_series(clean.to_months(table(spark, sf, "orders"), roles), roles)
    return features.design_matrix(series, ["group_id"]).select("group_id", F.col("t").cast("long").alias("t"))


@query("features_future_dates", with_(SERIES) + """SELECT group_id, s + 1 AS step, last_ds + CAST(floor(step_days * (s + 1)) AS INTEGER) AS ds FROM (
    SELECT group_id, max(ds) AS last_ds, CASE WHEN median(g) > 0 THEN median(g) ELSE 30 END AS step_days FROM (
        SELECT group_id, ds, date_diff('day', lag(ds) OVER (PARTITION BY group_id ORDER BY t), ds) AS g FROM series) GROUP BY 1), range(12) r(s)""")
def _(spark, sf):
    out = series_ops.future_dates(supplier_series(spark, sf), 12)
    return out.select("group_id", F.col("step").cast("long").alias("step"), "ds")

"""Inputs shared by several queries, derived from the driver tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keycast.config import Roles, RunOptions
from keycast.functions.skew import stable
from keycast.operators import clean
from keycast.operators import series as series_ops
from keycast.plans import forecast

# Models whose results SQL can reproduce; the tree models have queries of their own.
CLOSED_FORM = RunOptions(models=("trend_seasonal", "autoregressive"))

_kept: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, key: str, build):
    """Build a shared table once per session and reuse it."""
    full = (spark.sparkContext.applicationId, key)
    if full not in _kept:
        _kept[full] = build()
    return _kept[full]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    stable(spark.range(1))  # makes sure a checkpoint folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# -- events: dirty raw input ---------------------------------------------------

EVENT_ROLES = Roles("ts", "value", ("event_type",))
USER_ROLES = Roles("ts", "value", ("user_id",))


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose errors carry no value: gaps inside every user's timeline."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", value.alias("value"))


GAPPY = """gappy AS (SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


def text_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text, with unreadable entries where the payload says so."""
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", "event_type",
        F.when(F.col("props") == '{"k": 13}', F.lit("n/a")).otherwise(F.col("ts").cast("string")).alias("ts_text"),
        F.when(F.col("props") == '{"k": 17}', F.lit("unknown")).when(F.col("props") != '{"k": 19}', F.col("value").cast("string")).alias("value_text"),
    )


TEXT_EVENTS = """text_events AS (SELECT event_id, event_type,
    CASE WHEN props = '{"k": 13}' THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS ts_text,
    CASE WHEN props = '{"k": 17}' THEN 'unknown' WHEN props <> '{"k": 19}' THEN CAST(value AS VARCHAR) END AS value_text
    FROM events)"""
TEXT_ROLES = Roles("ts_text", "value_text", ("event_type",))

# -- monthly revenue per supplier: the series most queries run on --------------

SUPPLIER_ROLES = Roles("l_shipdate", "revenue", ("l_suppkey",))


def supplier_months(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue per supplier, rounded to the four decimals it has so both engines start from equal numbers."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", revenue.alias("revenue"))
    return clean.to_months(rows, SUPPLIER_ROLES).withColumn("revenue", F.round("revenue", 4))


def supplier_series(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, f"series:{sf}", lambda: stable(series_ops.build_series(supplier_months(spark, sf), SUPPLIER_ROLES)))


def supplier_run(spark: SparkSession, sf: str) -> forecast.Run:
    return once(spark, f"run:{sf}", lambda: forecast.forecast_series(supplier_series(spark, sf), "Monthly", CLOSED_FORM))


SERIES = """months AS (SELECT CAST(l_suppkey AS VARCHAR) AS group_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS y FROM lineitem GROUP BY 1, 2),
series AS (SELECT group_id, ds, y, row_number() OVER (PARTITION BY group_id ORDER BY ds) - 1 AS t,
    count(*) OVER (PARTITION BY group_id) AS n FROM months)"""

FRAME = SERIES + """,
folds AS (SELECT group_id, k AS fold, 3 * k AS train_start, 12 + 3 * k AS train_end
    FROM (SELECT DISTINCT group_id, n FROM series) s, range(5) r(k) WHERE n >= 15 + 3 * k),
spacing AS (SELECT group_id, max(n) AS n, max(ds) AS last_ds, median(gap) AS step_days FROM (
    SELECT *, date_diff('day', lag(ds) OVER (PARTITION BY group_id ORDER BY t), ds) AS gap FROM series) GROUP BY 1),
future AS (SELECT group_id, s + 1 AS step, last_ds + CAST(floor(step_days * (s + 1)) AS INTEGER) AS ds, n - 1 + s + 1 AS t
    FROM spacing, range(12) r(s)),
frame AS (
    SELECT f.group_id, f.fold, 'train' AS part, NULL AS step, s.t, s.ds, s.y, s.y AS train_y
      FROM folds f JOIN series s ON s.group_id = f.group_id AND s.t >= f.train_start AND s.t < f.train_end
    UNION ALL SELECT f.group_id, f.fold, 'test', s.t - f.train_end + 1, s.t, s.ds, s.y, NULL
      FROM folds f JOIN series s ON s.group_id = f.group_id AND s.t >= f.train_end AND s.t < f.train_end + 3
    UNION ALL SELECT group_id, -1, 'train', NULL, t, ds, y, y FROM series
    UNION ALL SELECT group_id, -1, 'test', step, t, ds, NULL, NULL FROM future)"""

NAIVE = """tail AS (SELECT group_id, fold, y, row_number() OVER (PARTITION BY group_id, fold ORDER BY t DESC) AS back,
    count(*) OVER (PARTITION BY group_id, fold) AS m FROM frame WHERE part = 'train'),
naive AS (SELECT x.group_id, 'seasonal_naive' AS model_name, x.fold, x.step, x.ds, x.y AS actual, k.y AS value,
    CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM frame x JOIN tail k
    ON k.group_id = x.group_id AND k.fold = x.fold AND k.back = CASE WHEN k.m >= 12 THEN 12 - (x.step - 1) % 12 ELSE 1 END
    WHERE x.part = 'test')"""

TREND = """line AS (SELECT group_id, fold, regr_slope(train_y, t) AS slope, regr_intercept(train_y, t) AS base
    FROM frame WHERE part = 'train' GROUP BY 1, 2),
rest AS (SELECT f.group_id, f.fold, month(f.ds) AS m, f.train_y - (l.base + l.slope * f.t) AS r
    FROM frame f JOIN line l USING (group_id, fold) WHERE f.part = 'train'),
season AS (SELECT group_id, fold, m, avg(r) AS s FROM rest GROUP BY 1, 2, 3),
noise AS (SELECT group_id, fold, coalesce(stddev_samp(r - s), 0) AS sigma FROM rest JOIN season USING (group_id, fold, m) GROUP BY 1, 2),
trend AS (SELECT f.group_id, 'trend_seasonal' AS model_name, f.fold, f.step, f.ds, f.y AS actual,
    l.base + l.slope * f.t + coalesce(s.s, 0) AS value, l.base + l.slope * f.t + coalesce(s.s, 0) - 1.96 * sigma AS lower,
    l.base + l.slope * f.t + coalesce(s.s, 0) + 1.96 * sigma AS upper
    FROM frame f JOIN line l USING (group_id, fold) JOIN noise USING (group_id, fold)
    LEFT JOIN season s ON s.group_id = f.group_id AND s.fold = f.fold AND s.m = month(f.ds) WHERE f.part = 'test')"""

AUTO = """lagged AS (SELECT group_id, fold, t, y0, level, lag(y0, 1) OVER w AS y1, lag(y0, 2) OVER w AS y2, lag(y0, 3) OVER w AS y3
    FROM (SELECT group_id, fold, t, avg(train_y) OVER (PARTITION BY group_id, fold) AS level,
        train_y - avg(train_y) OVER (PARTITION BY group_id, fold) AS y0 FROM frame WHERE part = 'train')
    WINDOW w AS (PARTITION BY group_id, fold ORDER BY t)),
moments AS (SELECT group_id, fold, CAST(count(*) AS DOUBLE) AS m, avg(y0) AS a0, avg(y1) AS a1, avg(y2) AS a2,
    covar_pop(y0, y0) AS v00, covar_pop(y0, y1) AS v01, covar_pop(y0, y2) AS v02, covar_pop(y1, y1) AS v11,
    covar_pop(y1, y2) AS v12, covar_pop(y2, y2) AS v22, avg((y0 - y1) * (y0 - y1)) AS s00, avg((y0 - y1) * (y1 - y2)) AS s01,
    avg((y0 - y1) * (y2 - y3)) AS s02, avg((y1 - y2) * (y1 - y2)) AS s11, avg((y1 - y2) * (y2 - y3)) AS s12,
    avg((y2 - y3) * (y2 - y3)) AS s22 FROM lagged WHERE y3 IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT group_id, fold, max(level) AS level, max_by(y0, t) AS l1, max_by(y1, t) AS l2, max_by(y2, t) AS l3 FROM lagged GROUP BY 1, 2),
slopes AS (
    SELECT *, 0 AS p, 0 AS d, 0.0 AS b1, 0.0 AS b2, v00 AS sigma2 FROM moments
    UNION ALL SELECT *, 0, 1, 0.0, 0.0, s00 FROM moments
    UNION ALL SELECT *, 1, 0, v01 / v11, 0.0, v00 - v01 / v11 * v01 FROM moments
    UNION ALL SELECT *, 1, 1, s01 / s11, 0.0, s00 - s01 / s11 * s01 FROM moments
    UNION ALL SELECT *, 2, 0, (v01 * v22 - v02 * v12) / (v11 * v22 - v12 * v12), (v02 * v11 - v01 * v12) / (v11 * v22 - v12 * v12),
        v00 - (v01 * v22 - v02 * v12) / (v11 * v22 - v12 * v12) * v01 - (v02 * v11 - v01 * v12) / (v11 * v22 - v12 * v12) * v02 FROM moments
    UNION ALL SELECT *, 2, 1, (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12), (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12),
        s00 - (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) * s01 - (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) * s02 FROM moments),
orders_ranked AS (SELECT *, m * ln(greatest(sigma2, 1e-9)) + 2 * (p + (1 - d) + 1) AS aic, row_number() OVER (PARTITION BY group_id, fold
    ORDER BY m * ln(greatest(sigma2, 1e-9)) + 2 * (p + (1 - d) + 1), p, d) AS rk FROM slopes
    WHERE abs(b2) < 1 AND b2 + b1 < 1 AND b2 - b1 < 1 AND m > p + (1 - d) + 1),
ar_fit AS (SELECT group_id, fold, level, l1, l2, l3, p, d, aic, greatest(sigma2, 1e-9) AS sigma2,
    CASE WHEN d = 0 THEN a0 - b1 * a1 - b2 * a2 ELSE 0 END AS a, CASE WHEN d = 0 THEN b1 ELSE 1 + b1 END AS c1,
    CASE WHEN d = 0 THEN b2 ELSE b2 - b1 END AS c2, CASE WHEN d = 0 THEN 0 ELSE -b2 END AS c3
    FROM orders_ranked JOIN ends USING (group_id, fold) WHERE rk = 1),
ar_path AS (
    SELECT group_id, fold, 1 AS step, level, sigma2, a, c1, c2, c3, a + c1 * l1 + c2 * l2 + c3 * l3 AS z1, l1 AS z2, l2 AS z3,
        CAST(1 AS DOUBLE) AS q1, CAST(0 AS DOUBLE) AS q2, CAST(0 AS DOUBLE) AS q3, CAST(1 AS DOUBLE) AS total FROM ar_fit
    UNION ALL SELECT group_id, fold, step + 1, level, sigma2, a, c1, c2, c3, a + c1 * z1 + c2 * z2 + c3 * z3, z1, z2,
        c1 * q1 + c2 * q2 + c3 * q3, q1, q2, total + (c1 * q1 + c2 * q2 + c3 * q3) * (c1 * q1 + c2 * q2 + c3 * q3)
    FROM ar_path WHERE step < 12),
auto AS (SELECT f.group_id, 'autoregressive' AS model_name, f.fold, f.step, f.ds, f.y AS actual, level + z1 AS value,
    level + z1 - 1.96 * sqrt(sigma2 * total) AS lower, level + z1 + 1.96 * sqrt(sigma2 * total) AS upper
    FROM frame f JOIN ar_path k ON k.group_id = f.group_id AND k.fold = f.fold AND k.step = f.step WHERE f.part = 'test')"""

PREDICTIONS = ", ".join([FRAME, NAIVE, TREND, AUTO, """predictions AS (
    SELECT p.* FROM (SELECT *, 0 AS pos FROM trend UNION ALL SELECT *, 1 FROM auto) p
    JOIN (SELECT DISTINCT group_id, n FROM series) s USING (group_id) WHERE n >= CASE pos WHEN 0 THEN 24 ELSE 20 END)"""])


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def materialized(sql: str, *names: str) -> str:
    """The same SQL with the named parts worked out once, for statements that read them many times over."""
    for name in names:
        sql = re.sub(rf"(?m)(^|\s|,){name} AS \(", rf"\g<1>{name} AS MATERIALIZED (", sql)
    return sql

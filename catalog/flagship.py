"""Which model should forecast each region's monthly revenue next year?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import CLOSED_FORM, table
from keycast.config import Roles
from keycast.functions.skew import stable
from keycast.operators import clean
from keycast.operators import series as series_ops
from keycast.plans import forecast

ROLES = Roles("o_orderdate", "o_totalprice", ("r_name",))


def region_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their region. The dimension tables are small and fixed; AQE decides how to join them."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    where = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    home = customers.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select("r_name", "o_orderdate", "o_totalprice")


def region_run(spark: SparkSession, sf: str) -> forecast.Run:
    months = clean.to_months(region_rows(spark, sf), ROLES).withColumn("o_totalprice", F.round("o_totalprice", 2))
    return forecast.forecast_series(stable(series_ops.build_series(months, ROLES)), "Monthly", CLOSED_FORM)


def region_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    run = region_run(spark, sf)
    chosen = run.selection.select("group_id", "model_name", "status", "composite_score", "statistic", "threshold")
    rows = run.winning.select("group_id", "model_name", "step", "ds", "value", "lower", "upper")
    return rows.join(chosen, ["group_id", "model_name"])

"""Registered queries over tables that the tests build."""

import datetime as dt
import math

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    day = lambda m: dt.datetime(2020 + m // 12, m % 12 + 1, 15)
    rows = [(s, day(m), 1000.0 * s + 40 * m + 90 * math.sin(m * (s + 1)), 0.0) for s in (1, 2, 3) for m in range(36)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_hyperparameter_records_hold_rank_and_order_of_every_pair(spark, tables):
    import __spark_entry__ as entry

    found = entry.queries()["result_hyperparameters"](spark, tables).where("NOT is_fallback").collect()
    assert len(found) == 6
    assert {r.model_name for r in found if r.p is not None and r.d is not None} == {"autoregressive"}
    assert {"final_rank", "p", "d"} <= set(found[0].asDict())
    assert "AS final_rank, p.p, p.d FROM" in entry.oracle_sql()["result_hyperparameters"]

"""Rows at positions of a global order, by counting."""

import random

import pytest
from pyspark.sql import functions as F

from keycast.functions.ranges import rows_at
from keycast.sources import tables


@pytest.fixture(scope="module")
def shuffled(spark):
    rnd = random.Random(1)
    rows = [(None if i % 50 == 0 else rnd.randrange(40), rnd.choice(["a", "B", None, "é"]), i) for i in range(3000)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a int, b string, i int").repartition(7)


def ordered(rows):
    first = lambda x: (x is not None, x if x is not None else 0)
    return sorted(rows, key=lambda r: (first(r[0]), (r[1] is not None, (r[1] or "").encode()), r[2]))


@pytest.mark.parametrize("few", [5000, 40])
def test_positions_equal_a_sort(shuffled, few):
    rows, df = shuffled
    want = ordered(rows)
    asked = [0, 1, 2, 777, 778, 1500, 2999, 4000]
    got = {r._position: (r.a, r.b, r.i) for r in rows_at(df, ["a", "b", "i"], lambda n: [p for p in asked if p < n], few=few).collect()}
    assert got == {p: want[p] for p in asked[:-1]}
    assert rows_at(df.limit(0), ["a"], lambda n: list(range(n))).count() == 0 and rows_at(df, ["a"], lambda n: []).count() == 0


def test_a_third_of_equal_rows_is_not_sorted(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"), F.lit("x").alias("w"))
    got = sorted((r._position, r.v) for r in rows_at(df, ["v"], lambda n: [0, 5, 299, 300, 301, n - 1], few=20).collect())
    others = [i for i in range(900) if i % 3]
    assert got == [(0, -1), (5, -1), (299, -1), (300, others[0]), (301, others[1]), (899, others[-1])]


def test_pages_cover_the_table_and_write_nothing(shuffled):
    rows, df = shuffled
    pages = [tables.page(df, ["a", "b"], k, 700) for k in range(1, 7)]
    seen = [r.i for p in pages for r in p.collect()]
    assert sorted(seen) == list(range(3000)) and pages[5].count() == 0
    plan = pages[2]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan

"""Checks of cases: what is read once stays read once, and trimming equals the expression it replaces."""

from pyspark.sql import functions as F

from keycast.functions import text as T
from keycast.operators import textcheck

TEXTS = ["", " ", "a", "　a b\x85\n", "\n\n a\x1c ", "x​ ", "\xa0. ", "Σας \t", None]


def test_strip_equals_the_expression_over_all_whitespace(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    regex = F.regexp_replace("x", f"^{T.SPACE}+|{T.SPACE}+$", "")
    assert rows.where(~F.col("x").isNull() & (T.strip(F.col("x")) != regex)).isEmpty()
    assert rows.where(T.strip(F.col("x")).isNull()).count() == 1


def test_judged_cases(spark):
    schema = "id int, summary string, selected_model string, said_model string, rejected array<struct<model_name:string,reason:string>>, reasons array<string>, metrics array<double>, schema_valid boolean"
    rows = [
        (1, "Prophet won. Arima lost its Trend. It cites 40.", "prophet", " Prophet", [("ARIMA", "missing trend")], None, [40.0], True),
        (2, "Prophet won. Arima came second. Prophet won.", "prophet", "arima", [("arima", "missing trend")], ["odd"], [1.0], True),
        (3, "Prophet won.", "prophet", "prophet", [("arima", "odd")], ["weak season"], [1.0], True),
        (4, None, "prophet", "prophet", None, None, [], True),
    ]
    got = {r.id: r for r in textcheck.judge_cases(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].rejections_ok for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[i].category for i in (1, 2, 3, 4)] == ["grounded", "contradictory", "grounded", "grounded"]
    assert [got[i].word_count for i in (1, 2, 3, 4)] == [9, 7, 2, 0]
    assert got[2].issues == ["repeated sentence"] and got[4].issues == ["empty"]


def test_a_window_is_built_once_per_candidate(spark):
    """Written out per keyword, the sentences were put to lower case some thirty times."""
    used = str(textcheck.rejections_accurate())
    assert "_windows" in used and "_low" not in used and "lower" not in used

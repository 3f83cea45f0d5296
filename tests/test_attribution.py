"""Attribution of row gains to keys: resamples drawn by length equal those drawn per key, and no join moves the gains."""

from pyspark.sql import functions as F

from keycast.functions.samples import draw
from keycast.operators.models import trees


def test_resamples_follow_the_draws_and_gains_are_not_joined_by_row(spark):
    sizes = {"a": 20, "b": 20, "c": 17}
    rows = [(k, p, c, 42, f, float((p * 7 + len(f) * (ord(k) + p)) % 5)) for k, c in sizes.items() for p in range(c) for f in ("lag_1", "month")]
    found = spark.createDataFrame(rows, "group_id string, p int, c long, seed int, feature string, gain double")
    made = trees.attributed(found, "linear")["window"].where("vector_id LIKE 'resample%'")
    got = {(r.group_id, r.vector_id, r.feature): r.weight for r in made.collect()}
    gains = {(k, p, f): g for k, p, _, _, f, g in rows}
    picks = spark.range(1, 21).crossJoin(spark.range(3).withColumnRenamed("id", "r"))
    drawn = {c: [(r.r, r.p) for r in picks.where(F.col("id") <= c).select("r", draw(F.col("r"), F.col("id"), 7, F.lit(c)).alias("p")).collect()] for c in (17, 20)}
    for key, c in sizes.items():
        for r in {r for r, _ in drawn[c]}:
            mean = {f: sum(gains[key, p, f] for at, p in drawn[c] if at == r) / c for f in ("lag_1", "month")}
            for f, value in mean.items():
                assert abs(got[key, f"resample_{r}", f] - value / sum(mean.values())) < 1e-12
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

"""Helpers that stay balanced when one key, date or value dominates the data.

A window partitioned by a business key puts the whole key in one task. Raw
input (before the monthly roll-up) has no bound on rows per key, so ordered
work on it goes through `chunked`: rows are range-partitioned on the full
ordering tuple, which cuts a hot key into many equal pieces, and only one
summary row per (chunk, key) crosses chunk borders.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder (`spark.checkpoint.dir`)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            # Only a local master, where driver and executors are one process, may do without the setting.
            if not context.master.startswith("local["):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
            folder = tempfile.mkdtemp(prefix="keycast-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition once for a run of per-key work.

    The number of partitions is stated, so adaptive execution does not merge
    small but compute-heavy partitions into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunked(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `_chunk`: equal slices of the global order given by `order`.

    `order` must end in a unique column so that no tuple repeats. The result is
    checkpointed because chunk borders come from sampling and are read twice.
    """
    return stable(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))


def global_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position of every row in the global order, without a global window."""
    slices = chunked(df, order)
    # One row per range partition, so this window and broadcast are bounded by the partition count.
    starts = slices.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("_chunk", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order)) - 1
    return (
        slices.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_chunk")
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_chunk", "_start", "_inside")
    )


def key_struct(keys: list[str]) -> Column:
    """All key columns as one struct: it is never null itself, and its null fields compare equal."""
    return F.struct(*keys) if keys else F.struct(F.lit(1))


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per row: its position in its key and the nearest non-null `value` on either side.

    Adds `_pos`, `_prev`, `_prev_pos`, `_next`, `_next_pos` (a present value is
    its own neighbour). Rows with null keys form a key of their own.
    """
    slices = chunked(df.withColumn("_key", key_struct(keys)), [*keys, *order])
    by = ["_chunk", "_key"]
    w = Window.partitionBy(*by).orderBy(*order)
    present = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("_at").alias("p")))
    local = (
        slices.withColumn("_at", F.row_number().over(w).cast("long"))
        .withColumn("_p", present)
        .withColumn("_before", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_after", F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    )
    summary = local.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("_at"))).alias("_last"),
        F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("_at"))).alias("_first"),
    )
    # Rows per key here are at most the number of range partitions.
    k = Window.partitionBy("_key").orderBy("_chunk")
    earlier, later = k.rowsBetween(Window.unboundedPreceding, -1), k.rowsBetween(1, Window.unboundedFollowing)
    summary = summary.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).cast("long"))
    lifted = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.v").alias("v"), (F.col(f"{c}.p") + F.col("_base")).alias("p")))
    summary = summary.withColumn("_last", lifted("_last")).withColumn("_first", lifted("_first"))
    summary = summary.select(
        *by,
        "_base",
        F.last("_last", True).over(earlier).alias("_carry"),
        F.first("_first", True).over(later).alias("_ahead"),
    )
    # `local` is already partitioned by (chunk, key): only the summary moves.
    return local.join(summary, by).select(
        *df.columns,
        (F.col("_at") + F.col("_base") - 1).alias("_pos"),
        F.coalesce(F.col("_before.v"), F.col("_carry.v")).alias("_prev"),
        (F.coalesce(F.col("_before.p") + F.col("_base"), F.col("_carry.p")) - 1).alias("_prev_pos"),
        F.coalesce(F.col("_after.v"), F.col("_ahead.v")).alias("_next"),
        (F.coalesce(F.col("_after.p") + F.col("_base"), F.col("_ahead.p")) - 1).alias("_next_pos"),
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Exact interpolated quantiles per key for groups of any size: `q_0`, `q_1`, …

    Equal values are counted map-side first; ranks then come from running
    counts over chunks of the (key, value) order, so no task holds a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    slices = chunked(counts.withColumn("_key", key_struct(keys)), [*keys, value])
    w = Window.partitionBy("_chunk", "_key").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = slices.withColumn("_cum", F.sum("_n").over(w))
    per_chunk = slices.groupBy("_chunk", "_key").agg(F.sum("_n").alias("_rows"))
    k = Window.partitionBy("_key")
    before = F.sum("_rows").over(k.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    per_chunk = per_chunk.select(
        "_chunk", "_key", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_rows").over(k).alias("_total")
    )
    ranked = local.join(per_chunk, ["_chunk", "_key"]).withColumn("_upto", F.col("_cum") + F.col("_base"))
    aggregates = []
    for i, p in enumerate(probabilities):
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        aggregates.append((low + (high - low) * part).alias(f"q_{i}"))
    return ranked.groupBy("_key").agg(*aggregates).select(*[F.col(f"_key.{c}").alias(c) for c in keys], *[f"q_{i}" for i in range(len(probabilities))])


def small_map(values: dict) -> Column:
    """Literal look-up map for a fixed table of a few entries."""
    pairs = []
    for k, v in values.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the key, for keys of any size."""
    # The key travels as a struct: rows with null keys form a key of their own and are not lost in the join.
    slices = chunked(df.withColumn("_key", key_struct(keys)), [*keys, *order])
    inside = Window.partitionBy("_chunk", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = slices.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = slices.groupBy("_chunk", "_key").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return local.join(sums, ["_chunk", "_key"]).withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)

"""Rows at given positions of a global order, found by counting, without sorting or writing the table.

A list of borders cuts the order into ranges, whose rows are counted in one
pass over the order columns. Ranges that hold a wanted position and are still
large get borders of their own, drawn by a hash of the key, and are counted
again. At the end only the rows of small ranges are read and sorted.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FEW = 20_000  # rows of a range that is read and sorted
FAN = 32  # borders that a large range gets in a round
SCALE = 1 << 30


def _literal(row, schema: StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema])


def _range_of(key: Column, borders: list, schema: StructType) -> Column:
    """How many borders are at or before the key, by bisection."""
    if not borders:
        return F.lit(0)
    cuts = F.array(*[_literal(b, schema) for b in borders])
    start = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(cuts, middle) <= key)
        return F.struct(
            F.when(right, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(borders).bit_length() + 1)), start, halve, lambda s: s["low"])


def rows_at(df: DataFrame, order: list[str], wanted: Callable[[int], list[int]], name: str = "_position", few: int = FEW) -> DataFrame:
    """The rows at the positions that `wanted` gives for the table's size, with their 0-based position as `name`.

    Nulls come first. Rows that agree in all of `order` are ranked in no
    particular way among themselves; a range of such rows alone is not sorted. What
    comes to the driver is a border and a count per range: a few dozen per wanted position and round.
    """
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("key"))
    schema = keys.schema["key"].dataType
    borders: list = []
    rate, positions, fresh = 0.0, None, True
    while True:
        placed = keys.withColumn("range", _range_of(F.col("key"), borders, schema))
        found = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").collect()
        if positions is None:
            positions = sorted(set(wanted(sum(r.n for r in found))))
        start, hit = 0, []
        for r in found:
            inside = positions[bisect.bisect_left(positions, start) : bisect.bisect_left(positions, start + r.n)]
            if inside:
                hit.append((r, start, inside))
            start += r.n
        large = [r for r, _, _ in hit if r.n > few and r.low != r.high]
        if not large:
            break
        numbers = [r.range for r in large]
        rate = FAN * len(large) / sum(r.n for r in large) if fresh else min(1.0, rate * 8)
        chosen = placed.where(F.col("range").isin(numbers) & (F.pmod(F.xxhash64("key", F.lit(len(borders))), F.lit(SCALE)) < int(max(1, rate * SCALE))))
        drawn = [r.key for r in chosen.select("key").distinct().limit(8 * FAN * len(large)).collect()]
        # The largest key of a range always cuts off something, so a round never stands still.
        fresh = len(drawn) > 0
        borders = in_order(df, [*borders, *drawn, *[r.high for r in large]], schema)
    if not hit:
        return df.limit(0).withColumn(name, F.lit(None).cast("long"))
    placed = df.withColumn("_range", _range_of(key, borders, schema))
    parts = []
    small = [(r, base, inside) for r, base, inside in hit if r.low != r.high or r.n <= few]
    if small:
        bases = F.array(*[F.struct(F.lit(r.range).alias("range"), F.lit(base).cast("long").alias("base")) for r, base, _ in small])
        base = F.element_at(F.filter(bases, lambda b: b["range"] == F.col("_range")), 1)["base"]
        number = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(f"`{c}`") for c in order])) - 1
        rows = placed.where(F.col("_range").isin([r.range for r, _, _ in small])).withColumn(name, (base + number).cast("long"))
        parts.append(rows.where(F.col(name).isin([p for _, _, inside in small for p in inside])))
    for r, base, inside in hit:
        if r.low == r.high and r.n > few:
            some = placed.where(F.col("_range") == r.range).limit(len(inside))
            listed = F.array(*[F.lit(p).cast("long") for p in inside])
            parts.append(some.withColumn(name, F.get(listed, F.row_number().over(Window.orderBy(F.lit(1))) - 1)))  # as many rows as were asked for
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_range")


def in_order(df: DataFrame, keys: list, schema: StructType) -> list:
    """Distinct keys in Spark's own order, so that borders compare as rows do; a few hundred of them."""
    if not keys:
        return []
    table = df.sparkSession.createDataFrame([(tuple(k),) for k in keys], StructType().add("key", schema))
    return [r.key for r in table.distinct().orderBy("key").collect()]

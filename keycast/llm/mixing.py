"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, then seeded selection.

Targets share a budget by weight, none above a bound of its source; what stops
at its bound is shared again by weight. Each source is dealt into shards of
bounded size. Blocks of equally many words go to shards one by one, each to the
highest quotient target / (2 * blocks so far + 1). That outcome is found without
the one-by-one walk: a shard ends with round(target / divisor) blocks, for the
divisor at which all blocks are given, and only the last few are ranked. In a
shard documents stand in a seeded order and blocks are taken from its start,
round and round, so that no document is taken more often than the bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.llm.shared import free, kept, stored


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by place of a source in code point order, again and again
    budget: float = 1.5  # words to take, as a multiple of all words
    most: float = 2.0  # bound of a target, as a multiple of its source's words
    block: int = 4  # words of a block
    shard_words: int = 500_000
    seed: int = 17


def word_count(text: Column) -> Column:
    """Words between blanks and control spaces; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """source, source_size, weight and target, of one row per source.

    Each round gives what is left to the sources below their bound; those that
    reach it stop there. A round is one sum over the sources.
    """
    # One row per source: sorted once, numbers follow from the order. Null comes last.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    shares = F.array(*map(F.lit, settings.weights))
    table = kept(sizes.withColumn("weight", shares[place % len(settings.weights)]).withColumn("bound", F.col("source_size") * settings.most))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("bound") <= F.col("weight") * level
        state = table.agg(
            F.sum(F.when(full, F.col("bound"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("stopped")
        ).first()
        if not state["open"] or state["stopped"] == stopped:
            break
        stopped = state["stopped"]
        level = (settings.budget * total - (state["held"] or 0.0)) / state["open"]
    target = F.least("bound", F.col("weight") * level).cast("double")
    return table.select("source", "source_size", "weight", target.alias("target"))


def apportion(items: DataFrame, seats: int, rounds: int = 12) -> DataFrame:
    """Add `seats` to items (id, weight, most): Sainte-Laguë quotas, none above `most`.

    The divisor is bracketed by sums of rounded quotas over all items, 16
    divisors in one pass; a quota between the two ends of the bracket is then
    decided by its quotients, ties by id. Fewer seats go out if all bounds are met.
    """
    held = kept(items)
    all_ = held.agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("most").alias("most"), F.max("weight").alias("top")).first()
    if not all_["n"] or not all_["w"] or seats <= 0:
        return held.withColumn("seats", F.lit(0).cast("long"))
    seats = min(seats, all_["most"])
    quota = lambda divisor: F.least(F.floor(F.col("weight") / divisor + 0.5), F.col("most"))
    # With the low divisor at least, with the high one at most `seats` go out.
    high, low = 2.1 * all_["top"], all_["w"] / (seats + all_["n"])
    while held.agg(F.sum(quota(low))).first()[0] < seats and low > all_["top"] * 1e-15:
        low /= 4
    for _ in range(rounds):
        steps = [low * (high / low) ** (k / 17) for k in range(1, 17)]
        sums = held.agg(*(F.sum(quota(d)).alias(f"s{k}") for k, d in enumerate(steps))).first()
        at_least = [d for k, d in enumerate(steps) if sums[k] >= seats]
        at_most = [d for k, d in enumerate(steps) if sums[k] <= seats]
        low, high = max([low, *at_least]), min([high, *at_most])
        if high / low < 1 + 1e-13 or any(sums[k] == seats for k in range(16)):
            break
    sure = held.withColumn("seats", quota(high).cast("long")).withColumn("_up", quota(low).cast("long"))
    left = seats - sure.agg(F.sum("seats")).first()[0]
    if left <= 0:
        return sure.drop("_up")
    # A handful of ties at most: items whose quota differs between two divisors that nearly agree.
    more = sure.where("_up > seats").select("id", "weight", F.explode(F.sequence(F.col("seats") + 1, F.col("_up"))).alias("k"))
    rank = F.row_number().over(Window.orderBy((F.col("weight") / (2 * F.col("k") - 1)).desc(), "id", "k"))
    more = more.withColumn("rank", rank).where(F.col("rank") <= left).groupBy("id").agg(F.count(F.lit(1)).alias("more"))
    return sure.join(more, "id", "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("_up", "more")


def mix(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source) and taken (words the mix takes, repeats counted), with its text's hash.

    A null source is a source of its own, the last one; null and empty texts
    have size 0 and are never taken; rows that repeat an id are rows of their
    own. The same rows give the same mix whatever their order or partitions:
    rows are ordered by a seeded hash of id and text.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")
    )
    rows = stored(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = kept(source_targets(per_source, settings))
    # Shards of a source have about shard_words words each, however many rows the source has.
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / settings.shard_words))
    key = F.struct("source")
    known = targets.select(key.alias("_key"), "source_size", "target", shards.alias("_shards"))
    dealt = rows.join(known, F.struct("source") == F.col("_key"))
    order = F.xxhash64(F.lit(settings.seed), "doc_id", "text_hash")
    dealt = dealt.withColumn("_order", order).withColumn("_shard", F.pmod(F.xxhash64(F.lit(settings.seed + 1), "_order"), "_shards"))
    dealt = dealt.drop("_key", "_shards")

    shard = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    most = F.floor(F.col("words") * settings.most / settings.block)
    weight = F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)
    items = shard.select(F.to_json(F.struct("source", "_shard")).alias("id"), "source", "_shard", "words", weight.alias("weight"), most.alias("most"))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportion(items.where("words > 0"), int(total // settings.block))
    quotas = quotas.select(F.struct("source", "_shard").alias("_quota_of"), (F.col("seats") * settings.block).alias("_take"), F.col("words").alias("_words"))

    inside = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(quotas, F.struct("source", "_shard") == F.col("_quota_of"), "left")
    turns = F.floor(F.col("_take") / F.col("_words"))
    rest = F.col("_take") - turns * F.col("_words")
    taken = turns * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("_before")))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), "source", "text_hash")


def mixed_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`docs` as the mix takes them: a row per time a document is taken, the last one cut to the words taken of it.

    All columns stay; n_chars is set anew. Rows without words have nothing to
    give and stay out; rows that repeat id, text and source share their part of the mix evenly.
    """
    key_name, size, taken, copy, new_text = free(docs, "_key", "_size", "_taken", "_copy", "_text")
    part = mix(docs, settings).where("taken > 0")
    part = part.groupBy("doc_id", "source", "text_hash").agg(F.first("size").alias(size), F.avg("taken").cast("long").alias(taken))
    key = F.struct("doc_id", "source", "text_hash")
    part = part.select(key.alias(key_name), size, taken)
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(text).alias("text_hash"))
    joined = docs.join(part, own == F.col(key_name))
    copies = F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)))
    rows = joined.withColumn(copy, F.explode(copies))
    words = F.least(size, F.col(taken) - (F.col(copy) - 1) * F.col(size))
    # The words of a text with the space before each; the first `words` of them make the cut text.
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), 0), F.lit(1), words.cast("int")), "")
    new = F.when(words < F.col(size), cut).otherwise(F.col("text"))
    columns = {"text": F.col(new_text), "n_chars": F.length(new_text).cast("long")}
    return rows.withColumn(new_text, new).select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))

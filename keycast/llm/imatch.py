"""I-Match fingerprints over a lexicon of terms from a band of inverse document frequencies, randomised many times.

Terms are words hashed into a fixed number of buckets, so that the statistics
of any corpus fit one table of known size. A bucket's document frequency counts
all documents; buckets inside the band make the lexicon, one bitmap of fixed
size. The lexicon is thinned again and again by halves, and each thinned lexicon
is cut at random into subsets. A document's terms in a subset, distinct and
sorted, are hashed to one part of its fingerprint. A text uses the three
thinnings in which its subsets hold about one term or fewer, so that long and
short texts alike keep some parts through an edit. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 20  # a power of two
    rarest: int = 2  # documents of a term, at least
    commonest: float = 0.05  # share of all documents, at most
    subsets: int = 64  # of each thinned lexicon
    levels: int = 3  # thinnings that a text uses
    seed: int = 11


def terms(text: Column, settings: Settings) -> Column:
    """Distinct term buckets of a text: lower-case runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    buckets = F.transform(words, lambda w: F.when(w == "", None).otherwise(F.xxhash64(w).bitwiseAND(F.lit(settings.buckets - 1)).cast("int")))
    return F.array_compact(F.array_distinct(buckets))


def lexicon(rows: DataFrame, settings: Settings, text: str = "text") -> Column:
    """The band as a bitmap of longs: `buckets` / 8 bytes whatever the corpus.

    Counts are summed within tasks first and have at most `buckets` rows.
    """
    total = rows.count()
    each = rows.select(F.explode(terms(F.col(text), settings)).alias("term"))
    count = each.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    # In a corpus of few documents the share alone would leave no term.
    most = max(10, int(settings.commonest * total))
    band = count.where(F.col("documents").between(min(settings.rarest, max(1, total)), most))
    words = band.groupBy(F.shiftright("term", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, term % 64)")).alias("bits"))
    all_words = rows.sparkSession.range(settings.buckets // 64).select(F.col("id").cast("int").alias("word"))
    filled = all_words.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bits = filled.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bitmap")).first()["bitmap"]
    # A constant the planner folds once; higher-order functions take no subqueries.
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def with_fingerprint(rows: DataFrame, text: str, name: str, bitmap: Column, settings: Settings) -> DataFrame:
    """Add the parts of a text's fingerprint, sorted by subset: one hash per subset that holds terms of the text.

    A text without terms of the lexicon has its own hash as its only part, an empty text none.
    """
    def known(t: Column) -> Column:
        return F.getbit(F.element_at(bitmap, F.shiftright(t, 6) + 1), t % 64) == 1

    # Steps are columns of their own, each worked out once per row.
    rows = rows.withColumn("_found", F.filter(terms(F.col(text), settings), known))
    # The first level has half a term to one in a subset; the low zero bits of a term's hash tell the last level it reaches.
    first = F.greatest(F.lit(0), F.floor(F.log2(2 * F.size("_found") / settings.subsets))).cast("int")
    rows = rows.withColumn("_first", F.coalesce(first, F.lit(0)))
    rows = rows.withColumn("_step", F.pow(F.lit(2), F.col("_first")).cast("long"))
    drawn = F.transform("_found", lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.lit(settings.seed)).alias("h")))
    thin = F.filter(drawn, lambda x: F.pmod(x["h"], F.col("_step")) == 0)

    def places(x: Column) -> Column:
        """(level, subset, term) for each level that the term reaches, as one number that sorts by all three."""
        subset = F.pmod(F.shiftright(x["h"], 40), F.lit(settings.subsets))
        reached = [F.pmod(x["h"], F.col("_step") * 2**k) == 0 for k in range(settings.levels)]
        keys = [((F.col("_first") + k).cast("long") * settings.subsets + subset) * settings.buckets + x["t"] for k in range(settings.levels)]
        return F.array_compact(F.array(*(F.when(r, k) for r, k in zip(reached, keys, strict=True))))

    rows = rows.withColumn("_keys", F.sort_array(F.flatten(F.transform(thin, places))))
    start = F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("hash"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(held: Column, key: Column) -> Column:
        slot = F.floor(key / settings.buckets)
        same = slot == held["slot"]
        return F.struct(
            slot.alias("slot"),
            F.xxhash64(F.when(same, held["hash"]).otherwise(slot), key).alias("hash"),
            F.when(same | (held["slot"] < 0), held["out"]).otherwise(F.concat(held["out"], F.array(held["hash"]))).alias("out"),
        )

    end = lambda held: F.concat(held["out"], F.array(held["hash"]))
    own = F.when(F.col(text) == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.xxhash64(F.lit(settings.seed), text)))
    parts = F.when(F.size("_keys") > 0, F.aggregate("_keys", start, step, end)).otherwise(own)
    return rows.withColumn(name, parts).drop("_found", "_first", "_step", "_keys")


def likeness(a: Column, b: Column) -> Column:
    """Share of common parts among all parts; 1 for two without any, so for two empty texts."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / together).cast("double")


def printed(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 16, "0")), "")


def with_next(rows: DataFrame, columns: list[str], range_rows: int = 1000, most_ranges: int = 10_000) -> DataFrame:
    """Add `next_` columns: those of the next row by id (null ids first, repeated ids by a hash of the text), after the last row the first.

    Rows are dealt into ranges of the order in one shuffle. The first row of a
    range is also a guest at the end of the range before, so no range has to
    look into another. Range borders come from ids and hashes alone; there are
    at most `most_ranges`, kept in two levels of lists.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), F.xxhash64("text").alias("h"))
    ids = rows.select(key.alias("key"))
    ranges = min(most_ranges, max(1, math.ceil(rows.count() / range_rows)))
    cuts = ids.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("cut"))
    cuts = sorted((tuple(row["cut"]) for row in cuts.collect()))  # at most most_ranges borders
    number, wide = max(1, len(cuts)), 100
    lists = [[dict(zip("kih", cut, strict=True)) for cut in cuts[k : k + wide]] for k in range(0, len(cuts), wide)]
    borders = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<k:boolean,i:bigint,h:bigint>>>")
    placed = rows.withColumn("_key", key).withColumn("_list", F.size(F.filter(borders, lambda c: c[0] <= F.col("_key"))) - 1)
    placed = placed.withColumn("_cuts", F.get(borders, F.col("_list")))
    placed = placed.withColumn("_in", F.size(F.filter("_cuts", lambda c: c <= F.col("_key"))) - 1)
    at_border = F.get("_cuts", F.col("_in")) == F.col("_key")
    home = F.col("_list") * wide + F.col("_in")
    before = F.pmod(home - 1 + number, number)
    stays = F.struct(home.alias("range"), F.lit(False).alias("guest"))
    visits = F.when(at_border, F.array(stays, F.struct(before.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(stays))
    dealt = placed.withColumn("_v", F.explode(visits)).drop("_list", "_in", "_cuts")
    inside = Window.partitionBy("_v.range").orderBy("_v.guest", "_key")
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns})
    return ahead.where("not _v.guest").drop("_v", "_key")


def compared(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and their likeness to each other and to the next row's.

    The edited text has its last half (rounded down) replaced by as many
    characters from the start of the next row's text, or all it has. A null
    text is empty; null ids come first; repeated rows are rows of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bitmap = lexicon(rows, settings)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    own = with_fingerprint(rows, "text", "own", bitmap, settings)
    both = with_next(own, ["text", "own"]).select(
        "doc_id", n.cast("long").alias("n_chars"), "own", "next_own",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    parts = with_fingerprint(both, "edited", "edited_parts", bitmap, settings).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return parts.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

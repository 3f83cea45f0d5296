"""Near duplicates by MinHash: an inverted join on the coordinates of signatures.

Sets of shingles are posted under the (coordinate, value) keys of their
signatures; a pair is meant to be looked at if it meets under at least `matches`
keys. The keys a pair has in common are not counted one by one: skip and prefix rules
leave out what cannot reach the bar, and what is left is judged by a sketch.
The rules lose no pair that reaches it: a key that one set alone
has joins nothing; a set with fewer shared keys than matches has no partner;
and of its shared keys, rarest first, all but the last `matches - 1` are
enough to meet every partner (prefix rule).

It goes in two steps. The short signature of every set only tells which sets
can have a partner at all. Those alone get the long signature, and a sketch of
one bit per further coordinate, by which a pair is judged inside the join.

Under one key all members are compared with the key's centre, the member whose
keys are the most popular, and what is confirmed on the full shingle sets is
merged. Members of the same component are not compared again, so a group of
thousands of close copies costs one comparison each. Pairs that remain in
different components are confirmed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast.llm.shared import bundles, free, in_python, kept, mix, running_hash, span_hash, stored


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.85 fails each of the three bounds on matches in under one of 10,000 cases, a closer one far less."""

    words: int = 5
    percent: int = 85  # link when 100 * intersection >= percent * union
    screen: int = 16  # coordinates of the short signature
    screen_matches: int = 7
    coordinates: int = 128  # of the long one
    matches: int = 92
    sketch: int = 1024  # bits
    sketch_matches: int = 912


# -- shingles -----------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts in a row, sorted within a text, and the count per text.

    A text of fewer than `words` words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    data = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    data = _FOLD[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = span_hash(running_hash(_SYMBOL[data]), starts, ends)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    out, sizes = [], np.zeros(len(texts), np.int64)
    factors = mix(np.arange(101, 101 + words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    places = max(0, len(hashes) - words + 1)
    whole = np.zeros(places, np.uint64)
    for k in range(words):
        whole += hashes[k : k + places] * factors[k]
    mix(whole)
    for i in range(len(texts)):
        low, high = first[i], first[i + 1]
        if high - low >= words:
            found = np.unique(whole[low : high - words + 1])
        elif high > low:
            short = hashes[low:high] * factors[: high - low]
            found = mix(np.array([short.sum(dtype=np.uint64) + np.uint64(high - low)], np.uint64))
        else:
            continue
        out.append(found)
        sizes[i] = len(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(texts: list[str], words: int, coordinates: int, bits: int = 0) -> pd.DataFrame:
    """Per text: set_id (128 bits of the whole set, null without shingles), n_shingles, signature and, if asked for, sketch."""
    hashes, sizes = shingle_sets(texts, words)
    full = np.flatnonzero(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1])).astype(np.int64) if len(full) else np.zeros(0, np.int64)
    out = pd.DataFrame({"set_id": [None] * len(texts), "n_shingles": sizes, "signature": [None] * len(texts), "sketch": [None] * len(texts)}, dtype=object)
    out["n_shingles"] = sizes
    if not len(full):
        return out
    keys, flags = np.zeros((len(full), coordinates), np.int64), np.zeros((len(full), bits), np.uint8)
    for k, (a, b) in enumerate(zip(*_coordinates(coordinates + bits), strict=True)):
        least = mix(np.minimum.reduceat(hashes * a + b, starts) + np.uint64(k))
        if k < coordinates:
            keys[:, k] = least.view(np.int64)  # (coordinate, value) as one number
        else:
            flags[:, k - coordinates] = least & np.uint64(1)
    ident = np.stack([np.add.reduceat(mix(hashes + np.uint64(s)), starts) for s in (1, 2)], axis=1)
    packed = np.packbits(flags, axis=1).view(np.int64)
    for row, i in enumerate(full):
        out.at[i, "set_id"], out.at[i, "signature"], out.at[i, "sketch"] = ident[row].tobytes(), keys[row], packed[row]
    return out


def shingled(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, set_id, n_shingles and short signature of every row; null texts have no set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for low, high in bundles(texts, 1_000_000):
                part = signatures(texts[low:high], settings.words, settings.screen)[["set_id", "n_shingles", "signature"]]
                for name in ("text_hash", "doc_id"):
                    part.insert(0, name, batch[name].iloc[low:high].astype("Int64").array)
                yield part

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return in_python(source, run, "doc_id long, text_hash long, set_id binary, n_shingles long, signature array<long>")


def _texts_of(source: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """set_id, text, size, signature and sketch of each wanted set, from the document that holds it."""
    joined = source.join(held, source["doc_id"].eqNullSafe(held["holder"])).select("set_id", "text")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for low, high in bundles(texts, 500_000):
                part = batch.iloc[low:high].reset_index(drop=True)
                found = signatures(texts[low:high], settings.words, settings.coordinates, settings.sketch)
                # Ids may repeat or be null: keep a row only if its text has the wanted set.
                same = [x is not None and x == bytes(y) for x, y in zip(found["set_id"], part["set_id"], strict=True)]
                part["size"], part["signature"], part["sketch"] = found["n_shingles"], found["signature"], found["sketch"]
                yield part[same]

    made = in_python(joined, full, "set_id binary, text string, size long, signature array<long>, sketch array<long>")
    return stored(made.dropDuplicates(["set_id"]), "sets")


# -- candidates ---------------------------------------------------------------


def _shared_keys(sets: DataFrame) -> DataFrame:
    """A row per set and key that another set has too."""
    posted = sets.select("set_id", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    return posted.join(shared, "key")


def postings(sets: DataFrame, settings: Settings) -> DataFrame:
    """set_id, popularity, prefix and key for each prefix key of the sets that can have a partner."""
    keys = _shared_keys(sets).groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("holders", "key"))).alias("keys"), F.sum(F.log2("holders")).alias("popularity")
    )
    keys = keys.where(F.size("keys") >= settings.matches)
    prefix = F.slice("keys", 1, F.size("keys") - (settings.matches - 1))["key"]
    return keys.select("set_id", "popularity", prefix.alias("prefix")).withColumn("key", F.explode("prefix"))


def _comparable(a: str, b: str, settings: Settings):
    return (F.col(a) * 100 >= F.col(b) * settings.percent) & (F.col(b) * 100 >= F.col(a) * settings.percent)


def centre_pairs(members: DataFrame, settings: Settings) -> DataFrame:
    """Each member of a key with the key's centre."""
    slim = members.select("key", "popularity", "size", "set_id")
    centre = slim.groupBy("key").agg(F.max(F.struct("popularity", "size", "set_id")).alias("c"), F.count(F.lit(1)).alias("n"))
    pairs = slim.join(centre.where("n > 1"), "key").where(F.col("set_id") != F.col("c.set_id"))
    pairs = pairs.where(_comparable("size", "c.size", settings))
    return pairs.select(F.least("set_id", "c.set_id").alias("a"), F.greatest("set_id", "c.set_id").alias("b")).distinct()


def open_pairs(members: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of members of one key that are in different components and alike by their sketches.

    A pair is made at the first key of its common prefix only, and judged
    inside the join, so that neither keys nor unlike pairs multiply rows.
    """
    columns = ("set_id", "size", "component", "sketch", "prefix")
    left, right = (members.select("key", *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    unlike = sum(F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(settings.sketch // 64))
    worth = (
        (F.col("set_id_a") < F.col("set_id_b")) & (F.col("component_a") != F.col("component_b")) & _comparable("size_a", "size_b", settings)
        & (unlike <= settings.sketch - settings.sketch_matches)
        & (F.array_intersect("prefix_a", "prefix_b")[0] == left["key"])
    )
    pairs = left.join(right, (left["key"] == right["key"]) & worth)
    return pairs.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))


# -- confirmation ---------------------------------------------------------------


def confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. `texts` has one text per set."""
    first = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}  # the last few sets, for a centre comes again and again

        def shingles(key: bytes, text: str) -> np.ndarray:
            found = held.get(key)
            if found is None:
                if len(held) >= 16:
                    held.pop(next(iter(held)))
                found = held[key] = shingle_sets([text or ""], settings.words)[0]
            return found

        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                x, y = shingles(bytes(a), text_a), shingles(bytes(b), text_b)
                common = np.intersect1d(x, y, assume_unique=True).size
                good.append(100 * common >= settings.percent * (x.size + y.size - common))
            yield batch.loc[good, ["a", "b"]]

    return in_python(both.select("a", "b", "text_a", "text_b"), check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """set_id and component (its smallest set_id) of every set that has a link.

    Every round each set takes the smallest label among its neighbours and
    itself, then the label of that label; labels halve their distance to the
    smallest one, so the rounds grow with the logarithm of a chain.
    """
    edges = kept(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    labels = edges.groupBy(F.col("x").alias("set_id")).agg(F.least(F.min("y"), F.first("x")).alias("component"))
    labels = kept(labels)
    while True:
        near = edges.join(labels, F.col("y") == F.col("set_id")).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("set_id") == F.col("x")).select("set_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = step.select(F.col("set_id").alias("component"), F.col("component").alias("up"))
        # Also the label given up learns of the smaller one.
        hint = step.groupBy(F.col("old").alias("set_id")).agg(F.min("component").alias("hint"))
        jump = step.join(up, "component", "left").join(hint, "set_id", "left")
        new = kept(jump.select("set_id", "old", F.least("component", "up", "hint").alias("component")))
        labels = new.select("set_id", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest id it is linked to, itself included), n_links, kept, text_hash and component_key.

    Documents with equal shingle sets are linked by their set and are not
    compared again. A text without words, or null, is linked with nothing. A
    null id never is a component's smallest; its row is kept only if no row of its
    component has an id. Rows that repeat an id stay rows of their own. Ids may
    be null or repeat, so `component_key` (smallest set of the component, null
    without words) and not component_id tells components apart. `n_links` counts the
    other distinct sets that the document's set was compared with and found
    similar to; members that are linked through their centre are not compared.
    """
    rows = stored(shingled(docs, settings, id_col, text_col), "minhash")
    sets = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("holder"), F.first("signature").alias("signature"))
    able = _shared_keys(sets.select("set_id", "signature")).groupBy("set_id").count().where(F.col("count") >= settings.screen_matches)
    held = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("holder")).join(able, "set_id")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = _texts_of(source, held, settings)
    members = stored(postings(texts, settings).join(texts.select("set_id", "size"), "set_id"), "postings")

    links = kept(confirmed(centre_pairs(members, settings), texts, settings))
    labels = components(links)
    rest = _unsettled(members, labels).join(texts.select("set_id", "sketch"), "set_id")
    fresh = kept(confirmed(open_pairs(rest, settings), texts, settings))
    links = kept(links.union(fresh).distinct())
    if not fresh.isEmpty():
        labels = components(links)

    degree = links.select(F.col("a").alias("set_id")).union(links.select("b")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = rows.groupBy("set_id").agg(F.min("doc_id").alias("least")).where(F.col("set_id").isNotNull())
    grouped = grouped.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "component").join(degree, "set_id", "left").select("set_id", "component_id", "n_links", F.col("component").alias("component_key"))
    # A third of all rows may share one set; the join's other side has one row per set, so a large partition can be split.
    result = rows.select("doc_id", "text_hash", "set_id", "n_shingles").join(known, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component_key",
    )


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one per component stays; texts without words all stay.

    The least id of the component stays, a null one only where none has an id. Where
    rows repeat that id, the smallest hash of their texts decides, equal rows leave one.
    """
    key, again = free(docs, "_key", "_again")
    found = near_duplicates(docs, settings)
    found = stored(found.groupBy("doc_id", "text_hash", "component_key", "kept").agg(F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles")), "verdicts")
    rest = found.where("kept and n_shingles > 0")
    # What is kept of one component has one id, or none.
    chosen = rest.groupBy("component_key", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.max("copies").alias("copies"))
    winners = chosen.select(F.struct("doc_id", "text_hash").alias(key), (F.col("copies") > 1).alias(again))
    empty = found.where("n_shingles = 0").select(F.struct("doc_id", "text_hash").alias(key), F.lit(False).alias(again)).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = docs.join(winners.union(empty), own == F.col(key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if winners.where(F.col(again)).isEmpty():
        return joined.select(*columns)
    once = joined.where(F.col(again)).dropDuplicates([key])
    return joined.where(~F.col(again)).select(*columns).union(once.select(*columns))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, one or more per component, of keys whose members are not all in one component."""
    known = members.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return known.join(mixed, "key")

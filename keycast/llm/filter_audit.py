"""What five text filters do to each other, in every order.

Four filters look at a text alone and are DataFrame expressions. The fifth,
exact duplicates, needs the whole table: texts are cut into ranges by prefixes that
grow only where a range would be too heavy, each task inserts the full texts of its
ranges into compressed radix tries whose terminals hold the smallest id, and a
walk over the trie tells who is a duplicate. The same trie runs before the shuffle on
a bounded share of each scan task: a row that meets a smaller id there is settled,
only the smallest row of each text travels on with the text. So a text
that a third of all rows share crosses the network once per batch of a task.

What is left of a document is five bits. They are counted per part and label,
and the 120 orders are worked out on those counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.llm.shared import ship, stored

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")


@dataclass(frozen=True)
class Settings:
    least_words: int = 200
    distinct_percent: int = 50
    capitals_percent: int = 3
    signs: str = "#$%&*|"
    range_share: float = 1e-5  # of all text in one range, within the next two bounds
    range_bytes: int = 1 << 20
    most_range_bytes: int = 64 << 20
    task_bytes: int = 32 << 20  # of text for one task, on the average: tasks grow in number with the table
    trie_bytes: int = 16 << 20  # a trie is walked and dropped at the end of the range in which it grows beyond
    first_prefix: int = 2  # bytes; a heavy prefix grows by `growth`
    growth: int = 4
    broadcast_rows: int = 2_000_000  # of eight bytes: heavy prefixes beyond this are joined by a shuffle


# -- filters of one text --------------------------------------------------------


def own_mask(text: Column, settings: Settings) -> Column:
    """Bits of the filters A to D that a text fails; bit 0 is A."""
    words = F.filter(F.split(text, "[\x20\x09-\x0d]+"), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    signs = "".join("\\" + c for c in settings.signs)
    fails = [
        count < settings.least_words,
        distinct * 100 < count * settings.distinct_percent,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * settings.capitals_percent,
        text.rlike(f"[{signs}]"),
    ]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0)).cast("int")


# -- the trie ---------------------------------------------------------------------


class Trie:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def terminal(self, text: bytes) -> list:
        """The terminal of a text, a list that the caller fills; an empty one is made for a new text."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                self.bytes += len(child[0]) + 200  # what a node takes besides, roughly
                at = len(text)
            elif text.startswith(child[0], at):
                at += len(child[0])
            else:
                child = self._split(node, child, text, at)
                at += len(child[0])
            node = child
        if node[2] is None:
            node[2] = []
        return node[2]

    @staticmethod
    def _split(parent: list, child: list, text: bytes, at: int) -> list:
        """Cut an edge after what it has in common with the text; at least one byte."""
        label, low, high = child[0], 1, len(child[0])
        while high - low > 1:
            middle = (low + high) // 2
            if text.startswith(label[:middle], at):
                low = middle
            else:
                high = middle
        upper = [label[:low], {label[low]: child}, None]
        child[0] = label[low:]
        parent[1][text[at]] = upper
        return upper

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """All texts with their terminals."""
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            todo += [(child, text) for child in node[1].values()]


_ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("text", pa.binary())])


def _settled(batches: Iterator[pa.RecordBatch], limit: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with what is known of their duplicates.

    A row without text has been settled before and passes. Of equal texts only rows
    of the smallest id stay open; they leave with their text, or, in the
    `last` pass, where equal texts are together under one `key` and keys come
    in order, without.
    """
    trie, out, size, previous = Trie(), [], 0, None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal trie, size, out
        for text, (least, *rows) in trie.walk():
            for part, mask in rows:
                out.append((least, part, mask, None if last else text))
                size += 0 if last else len(text)
            if size > 8 << 20 or len(out) >= 10_000:
                yield batch()
                out, size = [], 0
        trie = Trie()

    for incoming in batches:
        keys = incoming.column("key").to_pylist() if last else [None] * incoming.num_rows
        columns = (incoming.column(f.name).to_pylist() for f in _ROWS)
        for doc_id, part, mask, text, key in zip(*columns, keys, strict=True):
            if text is None or doc_id is None:
                out.append((doc_id, part, mask, None))
                continue
            if trie.bytes > limit and (not last or key != previous):
                yield from closed()
            previous = key
            held = trie.terminal(text)
            if not held:
                held += [doc_id, (part, mask)]
            elif doc_id == held[0]:
                held.append((part, mask))
            elif doc_id > held[0]:
                out.append((doc_id, part, mask | DUPLICATE, None))
            else:
                out += [(held[0], p, m | DUPLICATE, None) for p, m in held[1:]]
                held[:] = [doc_id, (part, mask)]
        if len(out) >= 10_000:
            yield batch()
            out, size = [], 0
    yield from closed()
    if out:
        yield batch()


# -- ranges -------------------------------------------------------------------------


def _prefix_of(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def heavy_prefixes(texts: DataFrame, settings: Settings) -> tuple[list[tuple[int, DataFrame, bool]], int]:
    """For each prefix length that is not enough: the hashes of its heavy prefixes, and whether they may be broadcast; and the bytes of all texts.

    Texts that are all equal cannot be cut and need not be. A length has at most
    as many heavy prefixes as ranges of the bound fit into the table.
    """
    levels, length, rest, total = [], settings.first_prefix, texts.select(F.col("text").cast("binary").alias("text")), None
    while True:
        sized = rest.groupBy(F.xxhash64(_prefix_of(F.col("text"), length)).alias("prefix")).agg(
            F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")
        )
        sized = stored(sized, "prefixes")
        if total is None:
            total = sized.agg(F.sum("bytes")).first()[0] or 0
            bound = min(settings.most_range_bytes, max(settings.range_bytes, int(settings.range_share * total)))
        heavy = sized.where((F.col("bytes") > bound) & (F.col("low") < F.col("high"))).select("prefix")
        count = heavy.count()
        if not count:
            return levels, total
        small = count <= settings.broadcast_rows
        levels.append((length, heavy, small))
        side = F.broadcast(heavy) if small else heavy
        rest = rest.join(side, F.xxhash64(_prefix_of(F.col("text"), length)) == F.col("prefix"), "left_semi")
        length *= settings.growth


def with_range(rows: DataFrame, levels: list[tuple[int, DataFrame, bool]], settings: Settings) -> DataFrame:
    """Add `key`: the shortest prefix of the text that is not heavy. Rows that are settled are spread by their id."""
    rows = rows.withColumn("key", _prefix_of(F.col("text"), settings.first_prefix))
    for length, heavy, small in levels:
        marked = heavy.select(F.col("prefix"), F.lit(True).alias("longer"))
        marked = F.broadcast(marked) if small else marked
        grown = (F.octet_length("key") == length) & (F.xxhash64("key") == F.col("prefix"))
        rows = rows.join(marked, grown if small else F.xxhash64("key") == F.col("prefix"), "left")
        rows = rows.withColumn("key", F.when(F.col("longer"), _prefix_of(F.col("text"), length * settings.growth)).otherwise(F.col("key"))).drop("prefix", "longer")
    return rows.withColumn("key", F.coalesce("key", F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))))


def masks(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, part and mask of all rows: bit k is set if the row fails filter k of `FILTERS`.

    Null texts are empty, and equal to each other. A row is a duplicate if its
    text stands under a smaller id anywhere in the table; rows that repeat an id are not
    duplicates of each other, and a null id is neither smaller nor larger.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    levels, total = heavy_prefixes(rows, settings)
    limit, schema = settings.trie_bytes, "doc_id long, part string, mask int, text binary"
    marked = rows.select("doc_id", "part", own_mask(F.col("text"), settings).alias("mask"), F.col("text").cast("binary").alias("text"))
    first = marked.mapInArrow(lambda batches: _settled(batches, limit, False), schema)
    ranged = with_range(first, levels, settings)
    ranges = max(1, math.ceil(total / settings.task_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = ranged.repartition(ranges, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _settled(batches, limit, True), schema).drop("text")


# -- orders -------------------------------------------------------------------------


def audited(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over rows of doc_id, part and mask; see `filter_audit`."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = masked.join(known, "doc_id", "left")
    sum_of = lambda flag: F.sum(F.when(F.col(flag), 1).otherwise(0))
    # At most 32 rows a part from here on.
    counted = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), sum_of("good").alias("good"), sum_of("toxic").alias("toxic"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.pow(F.lit(2), F.instr(F.lit(FILTERS), c) - 1).cast("int")))
    before = bits(F.expr("substring(filter_order, 1, step - 1)"))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", bits(F.col("letter"))).withColumn("before", before)
    earlier, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    of = lambda condition, count="n": F.sum(F.when(condition, F.col(count)).otherwise(0)).cast("long")
    report = steps.groupBy("part", "filter_order", "step", "letter").agg(
        of(~earlier & ~fails).alias("kept"), of(~earlier & fails).alias("removed"), of(earlier & fails).alias("redundant"),
        of(F.col("mask") == F.col("bit")).alias("unique_fails"), of(~earlier & fails, "good").alias("good_lost"), of(~earlier & fails, "toxic").alias("toxic_lost"),
    )
    # A filter has one row per order here.
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per part (language, empty for null), order of the filters and step: what is kept, removed, redundant, failed by this filter only, lost of good and of toxic documents, and the filter's Shapley sum.

    A document labelled more than once counts with its largest labels; labels
    without an id take no part. An empty table has no parts and no rows.
    """
    return audited(masks(docs, settings), labels)

"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is found by a running
exclusive-or of hashes of (place, role, text), 128 bits, so neither the texts nor the
paths travel: one group by (depth, hash) gives every node, its smallest member
and its counts. A node is known from then on by (smallest member, depth), and
the path to it is the rows of that member.

Totals over subtrees come from centroid decomposition of the parent-edge
forest. In a round each component finds its centroid, the deepest node
that holds at least half of the component's weight, adds the total below it to the
nodes on the path from the centroid to the component's top, and is cut there.
The weight of a node, turns of all members from it on, is a plain sum at the
node, so no rollup is needed to find centroids. Every round halves the weight of
each component; components small enough for one task are finished
there, by the same recursion. Deep chains therefore cost rounds that grow with the
logarithm of the weight, not with the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keycast.llm.shared import in_python, stored


@dataclass(frozen=True)
class Settings:
    every: int = 100  # conversations share the start of the one whose id is divisible by this
    most_shared: int = 6  # a conversation shares fewer turns than this
    in_task: int = 20_000  # nodes of a component that one task finishes
    ids: int = 10  # member ids are joined to text in spans of 2**ids, so a row holds at most so many


# -- turns in order -------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), two hashes of (role, text), and its code points, in the order of (turn, role, text), null turns first.

    Rows are range-partitioned on the conversation and the order, so a long
    conversation is cut into many pieces (`part`); only row counts per piece cross
    borders. Role and text enter the range key by their starts, to bound what
    Spark samples. Equal rows are turns of their own. Rows without conv_id
    take no part; null role or text is empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.where(F.col("conv_id").isNotNull())
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32))
    sorted_rows = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    # Numbered as they come out of the sort; the upper bits name the partition.
    slim = sorted_rows.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.length("text").cast("long").alias("chars"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
    )
    slim = stored(slim.withColumn("part", F.shiftright("at", 33)), "turns")
    pieces = slim.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = slim.join(pieces, ["conv_id", "part"])
    return joined.select("conv_id", "part", (F.col("at") - F.col("first") + F.col("base")).cast("long").alias("pos"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations: (conv_id, part, depth, h1, h2, chars) and (conv_id, turns).

    Conversation c takes the first h turns of c - c % every, all if there are
    fewer, none if that is absent, then its own after its first h;
    h = crc32(decimal c) % most_shared. `turns` may be 0.
    """
    first = settings.most_shared - 1
    shared = F.col("conv_id") % settings.every == 0
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.where(shared & (F.col("pos") < first)).select(F.col("conv_id").alias("source"), F.col("pos").alias("head_pos"), "h1", "h2", "chars")
    counts = own.where(shared).select(F.col("conv_id").alias("source"), F.least("own", F.lit(first)).alias("there"))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % settings.most_shared
    convs = own.select("conv_id", "own", share.alias("share"), (F.col("conv_id") - F.col("conv_id") % settings.every).alias("source")).join(counts, "source", "left")
    convs = convs.withColumn("taken", F.least("share", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("turns", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("share"))), "rebuilt")
    start = convs.where("taken > 0").join(heads, "source").where("head_pos < taken")
    start = start.select("conv_id", F.lit(-1).cast("long").alias("part"), (F.col("head_pos") + 1).alias("depth"), "h1", "h2", "chars")
    rest = turns.join(convs.select("conv_id", "share", "taken"), "conv_id").where("pos >= share")
    rest = rest.select("conv_id", "part", (F.col("pos") - F.col("share") + F.col("taken") + 1).alias("depth"), "h1", "h2", "chars")
    return start.union(rest), convs.select("conv_id", "turns")


# -- nodes ------------------------------------------------------------------------


def _prefixes(rows: DataFrame) -> DataFrame:
    """Add `x1`, `x2`: exclusive-or of the hashes of all turns up to this one; summed per piece, so that long conversations stay cut."""
    rows = rows.withColumn("s1", F.xxhash64(F.lit(11), "depth", "h1", "h2")).withColumn("s2", F.xxhash64(F.lit(12), "depth", "h2", "h1"))
    rows = stored(rows.select("conv_id", "part", "depth", "chars", "s1", "s2"), "places")
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("y1", F.expr("bit_xor(s1)").over(inside)).withColumn("y2", F.expr("bit_xor(s2)").over(inside))
    pieces = rows.groupBy("conv_id", "part").agg(F.expr("bit_xor(s1)").alias("t1"), F.expr("bit_xor(s2)").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda c: F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0).cast("long"))
    pieces = pieces.select("conv_id", "part", carry("t1").alias("b1"), carry("t2").alias("b2"))
    joined = local.join(pieces, ["conv_id", "part"])
    return joined.select("conv_id", "depth", "chars", "s1", "s2", F.col("y1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("y2").bitwiseXOR(F.col("b2")).alias("x2"))


def trie(conversations: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, paths and ends.

    nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, weight, chars.
    paths: conv_id, depth, node, up: for every conversation that is some node's
    smallest member, the smallest member of its node at that depth and at the one before.
    ends: conv_id, depth of a node, and `member`, a conversation with exactly these turns.
    """
    rows, convs = rebuilt(ordered_turns(conversations), settings)
    turns = _prefixes(rows).join(convs, "conv_id")
    turns = stored(turns, "prefixes")
    # Members of a node: each has one row there. Its weight counts their rows from it on.
    found = turns.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
        F.first("chars").alias("chars"), F.first("s1").alias("s1"), F.first("s2").alias("s2"),
    )
    found = stored(found, "nodes")
    parent = found.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("node").alias("above"))
    keyed = found.withColumn("p1", F.col("x1").bitwiseXOR(F.col("s1"))).withColumn("p2", F.col("x2").bitwiseXOR(F.col("s2")))
    # The root holds everyone: three numbers.
    root, members, weight = convs.agg(F.min("conv_id"), F.count(F.lit(1)), F.sum(F.col("turns") + 1)).first()
    number = lambda x: F.lit(x).cast("long")
    known = keyed.where("depth > 1").join(parent, ["depth", "p1", "p2"])
    top = keyed.where("depth = 1").withColumn("above", number(root))
    columns = ("node", "depth", "above", "n_convs", "weight", "chars", "x1", "x2")
    linked = stored(known.select(*columns).union(top.select(*columns)), "linked")
    nodes = linked.select(F.col("node").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "weight", "chars")
    whole = {"conv_id": root, "depth": 0, "parent_conv_id": None, "n_convs": members, "weight": weight, "chars": 0}
    nodes = nodes.union(conversations.sparkSession.range(1 if members else 0).select(*(number(v).alias(k) for k, v in whole.items())))

    placed = turns.select("conv_id", "depth", "turns", "x1", "x2").join(linked.select("depth", "x1", "x2", "node", "above"), ["depth", "x1", "x2"])
    placed = stored(placed.select("conv_id", "depth", "turns", "node", F.col("above").alias("up")), "paths")
    # A conversation that is not the smallest of its own last node is the smallest of none.
    leading = placed.where("depth = turns and node = conv_id").select("conv_id")
    paths = placed.join(leading, "conv_id").select("conv_id", "depth", "node", "up")
    ends = placed.where("depth = turns").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ends = ends.union(convs.where("turns = 0").select(number(root).alias("conv_id"), number(0).alias("depth"), F.col("conv_id").alias("member")))
    return nodes, paths, ends


# -- rollup -----------------------------------------------------------------------


def centroid_totals(parents: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Totals over subtrees of a forest by centroid decomposition.

    `parents` holds the place of each node's parent, -1 for a top; parents come
    before their children. A component with its nodes in that order is cut at its
    centroid into what hangs below each child and the rest.
    """
    wide = len(values[0]) if values else 0
    totals = [[0] * wide for _ in parents]
    home: list[int] = []  # the top of a node's tree
    groups: dict[int, list[int]] = {}
    for node, parent in enumerate(parents):
        home.append(node if parent < 0 else home[parent])
        groups.setdefault(home[node], []).append(node)
    open_parts = list(groups.values())
    size, piece = [0] * len(parents), [-1] * len(parents)
    while open_parts:
        part = open_parts.pop()
        for node in part:
            size[node], piece[node] = 1, -1
        for node in reversed(part[1:]):
            size[parents[node]] += size[node]
        # Nodes with half of the weight form a chain from the top; in this order the last is the deepest.
        centre = next(node for node in reversed(part) if 2 * size[node] >= len(part))
        below: dict[int, list[int]] = {}
        rest, total = [], list(values[centre])
        piece[centre] = centre
        for node in part:
            if node == centre:
                continue
            up = parents[node] if node != part[0] else -1
            if up == centre:
                piece[node] = node
            elif up >= 0 and piece[up] >= 0:
                piece[node] = piece[up]
            if piece[node] >= 0:
                below.setdefault(piece[node], []).append(node)
                total = [a + b for a, b in zip(total, values[node], strict=True)]
            else:
                rest.append(node)
        node = centre
        while True:  # from the centroid to the component's top
            totals[node] = [a + b for a, b in zip(totals[node], total, strict=True)]
            if node == part[0]:
                break
            node = parents[node]
        open_parts += below.values()
        if rest:
            open_parts.append(rest)
    return totals


def _finish(parts: DataFrame, names: list[str], settings: Settings) -> DataFrame:
    """Credits of nodes in components that one task can hold; a task takes whole components, a bounded number of nodes at a time."""

    def credits(rows: list[tuple]) -> pd.DataFrame:
        place = {(r[0], r[1]): i for i, r in enumerate(rows)}
        # A component's top may have a parent outside, which is not in these rows under the same component.
        parents = []
        for r in rows:
            at = place.get((r[2], r[1] - 1), -1) if r[2] is not None else -1
            parents.append(at if at >= 0 and rows[at][3:5] == r[3:5] else -1)
        totals = centroid_totals(parents, [r[5:] for r in rows])
        return pd.DataFrame([[*r[:2], *t] for r, t in zip(rows, totals, strict=True)], columns=["conv_id", "depth", *names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            # The root alone has no parent; ids must not pass through floats.
            above = [None if missing else int(x) for x, missing in zip(batch["parent_conv_id"], batch["no_parent"], strict=True)]
            numbers = [batch[c].tolist() for c in ("top_conv_id", "top_depth", *names)]
            for row in zip(batch["conv_id"].tolist(), batch["depth"].tolist(), above, *numbers, strict=True):
                if len(held) >= settings.in_task and held[-1][3:5] != row[3:5]:
                    yield credits(held)
                    held = []
                held.append(row)
        if held:
            yield credits(held)

    wanted = parts.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(0).cast("long")).alias("parent_conv_id"), F.col("parent_conv_id").isNull().alias("no_parent"),
        F.col("top.conv_id").alias("top_conv_id"), F.col("top.depth").alias("top_depth"), *names,
    )
    dealt = wanted.repartition("top_conv_id", "top_depth").sortWithinPartitions("top_conv_id", "top_depth", "depth", "conv_id")
    return in_python(dealt, run, "conv_id long, depth long, " + ", ".join(f"{n} long" for n in names))


def rolled_up(nodes: DataFrame, paths: DataFrame, names: list[str], settings: Settings = Settings()) -> DataFrame:
    """conv_id, depth and the totals over the node's subtree of the columns `names` (long, not null)."""
    # At first there is one component, whose top is the root; its id is the smallest of all.
    root = nodes.agg(F.min("conv_id")).first()[0]
    whole = F.struct(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"))
    open_nodes = stored(nodes.select("conv_id", "depth", "parent_conv_id", whole.alias("top"), "weight", *names), "open")
    credits = []
    while True:
        sizes = stored(open_nodes.groupBy("top").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("total")), "sizes")
        sized = open_nodes.join(sizes, "top")
        credits.append(_finish(sized.where(F.col("size") <= settings.in_task), names, settings))
        if sizes.where(F.col("size") > settings.in_task).isEmpty():
            break
        large = stored(sized.where(F.col("size") > settings.in_task), "large")
        heavy = large.where(F.col("weight") * 2 >= F.col("total"))
        centres = heavy.groupBy("top").agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
        centres = stored(centres.select("top", F.col("c.depth").alias("c_depth"), F.col("c.conv_id").alias("c_conv"), F.col("c.weight").alias("c_weight")), "centres")
        # A node hangs below its centroid if its path leads through it; the step after it names the piece.
        step = paths.select(F.col("conv_id"), (F.col("depth") - 1).alias("c_depth"), F.col("node").alias("piece"), F.col("up").alias("c_conv"))
        placed = large.join(centres, "top").join(step, ["conv_id", "c_depth", "c_conv"], "left")
        placed = stored(placed.withColumn("below", F.col("piece").isNotNull() & (F.col("depth") > F.col("c_depth"))), "cut")
        is_centre = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        totals = placed.where(F.col("below") | is_centre).groupBy("top", "c_conv", "c_depth", "c_weight").agg(*(F.sum(n).alias(n) for n in names))
        # From the parent of the centroid to the top of its component.
        way = paths.select(F.col("conv_id").alias("c_conv"), F.col("depth").alias("at"), "node")
        root_way = totals.where("top.depth = 0 and c_depth > 0").select(F.col("top.conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c_weight", *names)
        above = totals.join(way, "c_conv").where((F.col("at") >= F.col("top.depth")) & (F.col("at") < F.col("c_depth")))
        above = stored(above.select(F.col("node").alias("conv_id"), F.col("at").alias("depth"), "c_weight", *names).union(root_way), "above")
        credits.append(above.drop("c_weight"))
        credits.append(totals.select(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth"), *names))
        lower = placed.where("below").select("conv_id", "depth", "parent_conv_id", F.struct(F.col("piece").alias("conv_id"), (F.col("c_depth") + 1).alias("depth")).alias("top"), "weight", *names)
        upper = placed.where(~F.col("below") & ~is_centre).join(above.select("conv_id", "depth", F.col("c_weight").alias("lost")), ["conv_id", "depth"], "left")
        upper = upper.select("conv_id", "depth", "parent_conv_id", "top", (F.col("weight") - F.coalesce("lost", F.lit(0))).alias("weight"), *names)
        open_nodes = stored(lower.union(upper), "open")
    every = credits[0]
    for more in credits[1:]:
        every = every.union(more)
    return every.groupBy("conv_id", "depth").agg(*(F.sum(n).alias(n) for n in names))


# -- members ------------------------------------------------------------------------


def end_digests(ends: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, depth and SHA-256 of the decimal ids of `member`, ascending, joined by commas.

    Ids are joined to text in spans of the number line first, which bounds a
    row; the text of a node then streams through the hash span by span, so the hot
    node of a third of all conversations needs no memory. SHA-256 is one chain, so
    that text (not the rows behind it) passes through one task.
    """
    spans = ends.groupBy("conv_id", "depth", F.shiftright("member", settings.ids).alias("span")).agg(F.sort_array(F.collect_set("member")).alias("ids"))
    spans = spans.select("conv_id", "depth", "span", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    dealt = spans.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "span")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(batch["conv_id"].tolist(), batch["depth"].tolist(), batch["ids"], strict=True):
                if (conv, depth) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    return in_python(dealt, run, "conv_id long, depth long, ends_sha256 string")


def _long(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("long").alias(name)


def prefix_trie(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The order of a conversation is (turn, role, text), null turns first; equal
    rows are turns of their own. Rows without conv_id take no part. A table
    without conversations has no nodes, not even the root.
    """
    nodes, paths, ends = trie(conversations.select("conv_id", "turn", "role", "text"), settings)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", _long("n_children"))
    valued = valued.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", ((F.col("n_convs") - 1) * F.col("chars")).cast("long"))
    valued = stored(valued, "trie")
    totals = rolled_up(valued, stored(paths, "ways"), ["n_leaves", "saved_tokens"], settings)
    facts = valued.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    joined = facts.join(totals, ["conv_id", "depth"]).join(end_digests(ends, settings), ["conv_id", "depth"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

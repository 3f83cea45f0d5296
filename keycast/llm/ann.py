"""Nearest neighbours by collision counting with query-centred windows.

The index keeps, for each of many random projections, the vectors' positions on
one line, sorted. A query starts with a narrow window around its own position
on every line. Windows widen together, by a fixed factor (virtual rehashing:
no table is built again), and every vector that enters a window collides once
more. A vector with enough collisions is verified by its exact distance. A query
ends when the k-th verified distance is at most `reach` times the windows' half
width, and a set share of the block's vectors, which is a floor, was verified; or
when the windows hold everything.

Vectors are dealt into blocks of bounded size. A block's sorted lines are built
once, by one task, which then reads the queries as a stream: an index of any size
is built and searched in bounded memory, and only the queries are copied, once per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keycast.llm.shared import in_python, kept


@dataclass(frozen=True)
class Settings:
    lines: int = 64
    share: float = 0.62  # of the lines on which a vector must collide
    start: float = 0.5  # half width of the first window, in units of the block's spread
    widen: float = 1.25
    verify: float = 0.05  # of a block's vectors are verified before a query may end
    reach: float = 4.0  # half widths that the k-th verified distance may span
    block_rows: int = 32_768
    seed: int = 7


def _valid(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding (double) of the rows that take part: no null id, no null, zero or non-finite vector."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))


class Lines:
    """Sorted projections of one block of vectors of one dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, settings: Settings):
        order = np.argsort(ids, kind="stable")
        self.ids, self.data, self.settings = ids[order], data[order], settings
        random = np.random.default_rng(settings.seed)
        turns = -(-settings.lines // data.shape[1])
        # Orthogonal directions within each turn: together they keep lengths better than independent ones.
        self.directions = np.concatenate([np.linalg.qr(random.standard_normal((data.shape[1],) * 2))[0] for _ in range(turns)], axis=1)[:, : settings.lines]
        lines = self.data @ self.directions
        self.sorted = np.sort(lines, axis=0).T.copy()
        self.order = np.argsort(lines, axis=0, kind="stable").T.astype(np.int32)
        self.unit = max(float(lines.std(axis=0).mean()), 1e-12)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact distances of the nearest k verified vectors, ties to smaller ids."""
        s, n, lines = self.settings, len(self.ids), self.sorted.shape[0]
        center = query @ self.directions
        low = np.array([np.searchsorted(self.sorted[j], center[j]) for j in range(lines)])
        high = low.copy()
        hits = np.zeros(n, dtype=np.uint16)
        need, half = math.ceil(s.share * lines), s.start * self.unit
        least = min(n, max(4 * k, math.ceil(s.verify * n)))
        known, squares = np.zeros(n, dtype=bool), np.full(n, np.inf)
        known[self.ids == query_id] = True  # never its own neighbour
        while True:
            for j in range(lines):
                line = self.sorted[j]
                a = np.searchsorted(line, center[j] - half, "left")
                b = np.searchsorted(line, center[j] + half, "right")
                hits[self.order[j, a : low[j]]] += 1  # a line names a vector once, so no index repeats
                hits[self.order[j, high[j] : b]] += 1
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            over = hits >= need
            if over.sum() >= least or (high - low).min() == n:
                fresh = np.flatnonzero(over & ~known)
                known[fresh] = True
                squares[fresh] = ((self.data[fresh] - query) ** 2).sum(axis=1)
                kth = np.partition(squares, k - 1)[k - 1] if n >= k else np.inf
                if (high - low).min() == n or kth <= (s.reach * half) ** 2:
                    break
            half *= s.widen
        found = np.flatnonzero(np.isfinite(squares))
        distance = np.sqrt(squares[found])
        best = np.lexsort((self.ids[found], distance))[:k]
        return self.ids[found[best]], distance[best]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's nearest k found, never itself.

    Both tables have vec_id and embedding (see `vectors`). Only vectors of the
    query's own dimension are candidates. Ties go to the smaller vec_id; with
    fewer than k candidates all come back; a query without any has no rows.
    Rows of one table that repeat an id count as one neighbour each, but none of them is a neighbour of a query with that id.
    """
    candidates, queries = kept(candidates), kept(queries)
    blocks = max(1, math.ceil(candidates.count() / settings.block_rows))
    dealt = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    rows = dealt.unionByName(asked).withColumn("n", F.size("embedding")).select("block", "n", "asks", "vec_id", "embedding")
    # A block's vectors of one dimension come first, its queries behind them.
    placed = rows.repartition(blocks, "block", "n").sortWithinPartitions("block", "n", "asks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, data, lines = None, [], [], None
        for batch in batches:
            out = []
            for block, n, asks, vec_id, vector in zip(batch["block"], batch["n"], batch["asks"], batch["vec_id"], batch["embedding"], strict=True):
                if (block, n) != at:
                    at, ids, data, lines = (block, n), [], [], None
                if not asks:
                    ids.append(vec_id)
                    data.append(vector)
                elif ids:
                    lines = lines or Lines(np.array(ids, np.int64), np.stack(data), settings)
                    near, scores = lines.search(vec_id, np.asarray(vector, np.float64), k)
                    out.append(pd.DataFrame({"query_id": vec_id, "vec_id": near, "score": scores}))
            if out:
                yield pd.concat(out)

    found = in_python(placed, search, "query_id long, vec_id long, score double")
    # At most k rows of a query come from each block, and Spark keeps k per task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_every(table: DataFrame, every: int = 100, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Nearest neighbours of the rows whose id is divisible by `every`, among all rows."""
    rows = vectors(table)
    return nearest(rows.where(F.col("vec_id") % every == 0), rows, k, settings)

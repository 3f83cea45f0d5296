"""Two-sample statistics of many keys at once, by numpy inside Spark's tasks.

A null needs hundreds of statistics per key. Keys of equal length, statistic and
method go through numpy together, a bounded number at a time; the formulas are those of
`functions/samples.py`, step by step, and ties between counts stay ties.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions travel to the workers by value: no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PSI, KS, WASSERSTEIN = "population_stability_index", "kolmogorov_smirnov", "wasserstein_distance"
EPSILON = 1e-9
AT_ONCE = 500_000  # values held in one array
MASK = 0xFFFFFFFF


def draw(iteration: np.ndarray, position: np.ndarray, side: int, size: int, seed: int) -> np.ndarray:
    """`samples.draw` over whole arrays."""
    h = (iteration * 7919 + position * 104729 + ((side * 1299709 + seed * 15485863) & MASK)) & MASK
    h = ((h ^ (h >> 15)) * 739982445) & MASK
    h = ((h ^ (h >> 12)) * 695872825) & MASK
    return (h ^ (h >> 15)) % size


# -- statistics of the rows of two sorted matrices ---------------------------------


def _quantile(ordered: np.ndarray, p: float) -> np.ndarray:
    at = (ordered.shape[1] - 1) * p
    low, high = ordered[:, math.floor(at)], ordered[:, math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def _gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between neighbours of the joint sample and the CDF gap over each, times n_a * n_b."""
    both = np.concatenate([a, b], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    gap = np.abs(np.cumsum(np.where(order < a.shape[1], b.shape[1], -a.shape[1]), axis=1)[:, :-1])
    return np.diff(np.take_along_axis(both, order, axis=1), axis=1), gap


def kolmogorov_smirnov(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    steps, gap = _gaps(a, b)
    return np.where(steps != 0, gap, 0).max(axis=1, initial=0) / (float(a.shape[1]) * b.shape[1])


def wasserstein(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    steps, gap = _gaps(a, b)
    raw = (gap * steps).sum(axis=1) / (float(a.shape[1]) * b.shape[1])
    spread = np.where(a[:, 0] == a[:, -1], 0.0, a.std(axis=1))
    return np.where(spread > 0, raw / np.where(spread > 0, spread, 1.0), raw)


def _below(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return (values < edge[:, None]).sum(axis=1)


def _index(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """PSI over each row's distinct edges, open at both ends."""
    first, last = edges[:, 0], edges[:, -1]
    fresh = np.concatenate([np.ones((len(a), 1), bool), edges[:, 1:] != edges[:, :-1]], axis=1)
    bins = fresh.sum(axis=1) - 1
    total, before = np.zeros(len(a)), (np.zeros(len(a)), np.zeros(len(a)))
    for i in range(1, edges.shape[1]):
        edge = edges[:, i]
        at = lambda values: np.where(edge == first, 0, np.where(edge == last, values.shape[1], _below(values, edge)))
        now = (at(a), at(b))
        p, q = [(n - m + 1) / (values.shape[1] + bins) for n, m, values in zip(now, before, (a, b), strict=True)]
        total += np.where(fresh[:, i], (q - p) * np.log(q / p), 0.0)
        before = now
    return total


def stability_index(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    deciles = np.stack([_quantile(a, i / 10) for i in range(11)], axis=1)
    out = _index(a, b, deciles)
    few = (deciles[:, 1:] != deciles[:, :-1]).sum(axis=1) < 2
    if few.any():
        rest = a[few]
        out[few] = _index(rest, b[few], np.stack([_quantile(rest, p) for p in (0.0, 0.5, 1.0)], axis=1))
    return out


def jensen_shannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, -1], b[:, -1])
    width = (high - low) / 10
    total, before = np.zeros(len(a)), (np.zeros(len(a)), np.zeros(len(a)))
    for i in range(1, 11):
        now = tuple(_below(v, low + i * width) if i < 10 else np.full(len(v), v.shape[1]) for v in (a, b))
        p, q = [(n - m + EPSILON) / (v.shape[1] + EPSILON * 10) for n, m, v in zip(now, before, (a, b), strict=True)]
        middle = (p + q) / 2
        total += p * np.log(p / middle) + q * np.log(q / middle)
        before = now
    return np.where(low == high, 0.0, np.sqrt(np.maximum(total, 0.0) / (2 * math.log(2))))


def two_sample(algorithm: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The statistic of every row of two matrices, as `samples.two_sample` gives it."""
    a, b = np.sort(a, axis=1), np.sort(b, axis=1)
    # A bin that holds a NaN or nothing at all is the data's own affair, not a fault to report.
    with np.errstate(all="ignore"):
        return {PSI: stability_index, KS: kolmogorov_smirnov, WASSERSTEIN: wasserstein}.get(algorithm, jensen_shannon)(a, b)


# -- nulls --------------------------------------------------------------------------


def chunk_statistics(histories: np.ndarray, algorithm: str) -> np.ndarray:
    """Statistics between adjacent chunks, sizes as even as possible, larger ones first."""
    n = histories.shape[1]
    k = max(2, min(4, n // 6))
    begin = [i * (n // k) + min(i, n % k) for i in range(k + 1)]
    parts = [histories[:, begin[i] : begin[i + 1]] for i in range(k)]
    return np.stack([two_sample(algorithm, parts[i], parts[i + 1]) for i in range(k - 1)], axis=1)


@functools.lru_cache(maxsize=64)
def _drawn(n: int, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that every resample takes from the earlier and the later half; the length alone sets them."""
    half = max(1, n // 2)
    rows = np.arange(resamples, dtype=np.int64)[:, None]
    take = lambda side, size: draw(rows, np.arange(1, size + 1, dtype=np.int64)[None, :], side, size, seed)
    return take(1, half), half + take(2, n - half)


def resample_statistics(histories: np.ndarray, algorithm: str, resamples: int, seed: int) -> np.ndarray:
    """Statistics between bootstrap resamples of the two halves."""
    n = histories.shape[1]
    early, late = _drawn(n, resamples, seed)
    out, few = np.empty((len(histories), resamples)), max(1, AT_ONCE // (resamples * n))
    for at in range(0, len(histories), few):
        some = histories[at : at + few]
        a, b = (some[:, places].reshape(len(some) * resamples, -1) for places in (early, late))
        out[at : at + few] = two_sample(algorithm, a, b).reshape(len(some), resamples)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _rows(values: np.ndarray, offsets: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
    return values[offsets[which][:, None] + np.arange(size)[None, :]]


def _together(*columns: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """The places of rows that agree in all columns."""
    places: dict = {}
    for i, key in enumerate(zip(*columns, strict=True)):
        places.setdefault(key, []).append(i)
    for key, found in places.items():
        yield key, np.array(found)


def null_batches(resamples: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (group_id, algorithm, method, history) to (group_id, method, null_size, statistics in the order drawn)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, algorithm, method, history = batch.columns
            values, offsets = _lists(history)
            found: list = [None] * batch.num_rows
            for (size, alg, how), which in _together(np.diff(offsets), algorithm.to_pylist(), method.to_pylist()):
                rows = _rows(values, offsets, which, size)
                scored = chunk_statistics(rows, alg) if how == "percentile" else resample_statistics(rows, alg, resamples, seed)
                for place, statistics in zip(which, scored, strict=True):
                    found[place] = statistics
            sizes = [len(f) for f in found]
            packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([group, method, pa.array(sizes, pa.int64()), packed], names=["group_id", "method", "null_size", "statistics"])

    return made


# -- thresholds -----------------------------------------------------------------------


def _percentile(ordered: np.ndarray, p: float) -> np.ndarray:
    """Spark's `percentile` of sorted rows."""
    at = (ordered.shape[1] - 1) * p
    low, high = ordered[:, math.floor(at)], ordered[:, math.ceil(at)]
    return np.where(low == high, low, (math.ceil(at) - at) * low + (at - math.floor(at)) * high)


def smoothed(ordered: np.ndarray, width: np.ndarray, percentile: float, draws: int, seed: int) -> np.ndarray:
    """Percentile of draws from a Gaussian kernel density over each row (Scott bandwidth)."""
    places = np.arange(draws, dtype=np.int64)
    u = lambda side: (draw(places, np.int64(side), side, 1_000_000, seed) + 0.5) / 1_000_000.0
    normal = np.sqrt(-2 * np.log(u(5))) * np.cos(u(6) * 6.283185307179586)
    picks = draw(places, np.int64(4), 4, ordered.shape[1], seed)
    out, few = np.empty(len(ordered)), max(1, AT_ONCE // draws)
    for at in range(0, len(ordered), few):
        drawn = ordered[at : at + few, picks] + width[at : at + few, None] * normal[None, :]
        drawn.sort(axis=1)
        out[at : at + few] = _quantile(drawn, percentile)
    return out


def threshold_batches(percentile: float, draws: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (group_id, method, null_size, statistics) to (group_id, null_size, read)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group, method, null_size, statistics = batch.columns
            values, offsets = _lists(statistics)
            read, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for (size, how), which in _together(np.diff(offsets), method.to_pylist()):
                if not size:
                    continue
                ordered = np.sort(_rows(values, offsets, which, size), axis=1)
                limit = _percentile(ordered, percentile)
                if how == "kernel_density" and size > 1:
                    spread = np.std(ordered - ordered[:, :1], axis=1, ddof=1)
                    wide = spread > 0
                    limit[wide] = smoothed(ordered[wide], spread[wide] * float(size) ** -0.2, percentile, draws, seed)
                read[which], known[which] = limit, True
            yield pa.RecordBatch.from_arrays([group, null_size, pa.array(read, mask=~known, from_pandas=False)], names=["group_id", "null_size", "read"])

    return made

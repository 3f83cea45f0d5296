"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keycast.llm.shared import bundles, in_python, inverse_powers, running_hash, ship


@dataclass(frozen=True)
class Settings:
    """Shape of the features and of the fit."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)  # characters of an n-gram
    bits: int = 20  # features are hashed into 2**bits buckets
    most_per_label: int = 2000  # bound of the fit: labelled documents of each label
    least_documents: int = 4  # a feature needs so many documents of the fit
    least_ratio: float = 0.7  # and a log-count ratio of at least so much either way
    penalty: float = 1e-3
    rounds: int = 80


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _grams(texts: list[str], settings: Settings):
    """For each n-gram size: the buckets at all places of the joined texts, and the text of each place (-1 across a border)."""
    joined = "\x00".join(f" {' '.join(text.lower().split())} " for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.cumsum(points == 0, dtype=np.int32)
    prefix = running_hash((points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    for n in settings.sizes:
        places = max(0, len(points) - n + 1)
        hashes = (prefix[n:] - prefix[:places]) * inverse_powers(places)[:places]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        buckets = (hashes >> np.uint64(64 - settings.bits)).astype(np.int32)
        # A border counts with the text behind it; no n-gram may hold one.
        yield buckets, owner[:places], (owner[:places] == owner[n - 1 :][:places]) & (points[:places] != 0)


def features(texts: list[str], settings: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order; with `wanted`, only buckets where it is true."""
    keys = []
    for buckets, owner, inside in _grams(texts, settings):
        if wanted is not None:
            inside &= wanted[buckets]
        keys.append(owner[inside].astype(np.int64) << settings.bits | buckets[inside])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return (keys >> settings.bits).astype(np.int64), (keys & ((1 << settings.bits) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the buckets that count, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[str]) -> np.ndarray:
        wanted = np.zeros(1 << self.settings.bits, dtype=bool)
        wanted[self.buckets] = True
        table = np.zeros(1 << self.settings.bits, dtype=np.float64)
        table[self.buckets] = self.weights
        out = np.full(len(texts), self.bias)
        for low, high in bundles(texts, 500_000):
            owner, bucket = features(texts[low:high], self.settings, wanted)
            out[low:high] += np.bincount(owner, weights=table[bucket], minlength=high - low)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, settings: Settings) -> Model:
    """Logistic regression on presence of n-grams times their log-count ratio.

    `weights` is how many labelled documents a row stands for, so that the
    intercept follows the whole labelled set. Without both labels the score is
    the share of label 1 (0 without any row).
    """
    total, ones = weights.sum(), (weights * labels).sum()
    if not 0 < ones < total:
        bias = 50.0 if total and ones == total else -50.0
        return Model(np.zeros(0, np.int32), np.zeros(0), bias, settings)
    size = 1 << settings.bits
    positive, documents = np.zeros(size), np.zeros(size)
    for low, high in bundles(texts, 500_000):
        owner, bucket = features(texts[low:high], settings)
        positive += np.bincount(bucket, weights=labels[low:high][owner], minlength=size)
        documents += np.bincount(bucket, minlength=size)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    ratio = np.log((positive + 1) / (n1 + 2)) - np.log((documents - positive + 1) / (n0 + 2))
    wanted = (documents >= settings.least_documents) & (np.abs(ratio) >= settings.least_ratio)
    chosen = np.flatnonzero(wanted)
    place = np.zeros(size, np.int32)
    place[chosen] = np.arange(len(chosen))
    owners, columns = [], []
    for low, high in bundles(texts, 500_000):  # a second reading keeps only the features that count
        owner, bucket = features(texts[low:high], settings, wanted)
        owners.append((owner + low).astype(np.int32))
        columns.append(place[bucket])
    owner, column = np.concatenate(owners), np.concatenate(columns)
    scale = ratio[chosen]
    share = weights / total
    w, b = np.zeros(len(chosen)), float(np.log(ones / (total - ones)))
    # Accelerated gradient descent; the step follows from a bound of the curvature, kept by checking the loss.
    look_w, look_b, momentum, step = w.copy(), b, 1.0, 1.0

    def outcome(w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(owner, weights=(w * scale)[column], minlength=len(labels)) + b

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float((share * (np.logaddexp(0, z) - labels * z)).sum() + settings.penalty / 2 * (w @ w))

    for _ in range(settings.rounds):
        z = outcome(look_w, look_b)
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        grad = np.bincount(column, weights=error[owner], minlength=len(chosen)) * scale + settings.penalty * look_w
        grad_b, here = error.sum(), loss(z, look_w)
        while True:
            new_w, new_b = look_w - step * grad, look_b - step * grad_b
            if step < 1e-6 or loss(outcome(new_w, new_b), new_w) <= here - step / 2 * (grad @ grad + grad_b**2):
                break
            step /= 2
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        look_w = new_w + (momentum - 1) / following * (new_w - w)
        look_b = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum, step = new_w, new_b, following, step * 1.5
    return Model(chosen.astype(np.int32), w * scale, b, settings)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample: of each label the `most_per_label` documents first by a hash of their id.

    Labels come from documents that are not held out. A document labelled more
    than once counts with its largest label; null ids, labels and texts do not
    take part. The fit runs in one task on the bounded sample; only the model,
    bounded by the number of buckets, reaches the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = dict(known.groupBy("label").count().collect())
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_per_label)
        sample = part if sample is None else sample.union(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # At most 2 * most_per_label rows of ids and labels.
    rows = text.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches) or [pd.DataFrame(columns=["doc_id", "text", "label"])])
        table = table.drop_duplicates(["doc_id", "text"]).sort_values(["doc_id", "text"])
        y = table["label"].to_numpy(dtype=np.float64)
        stands = np.array([there.get(int(v), 0) / max(1, (y == v).sum()) for v in y], dtype=np.float64)
        model = fit(table["text"].tolist(), y, stands, settings)
        yield pd.DataFrame({"buckets": [model.buckets.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})

    row = in_python(rows.repartition(1), learn, "buckets binary, weights binary, bias double").first()
    if row is None:
        return fit([], np.zeros(0), np.zeros(0), settings)
    return Model(np.frombuffer(row.buckets, np.int32), np.frombuffer(row.weights, np.float64), row.bias, settings)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of `docs`, as they are, and a column `name` in 0 to 1; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield batch.append_column(name, pa.array(model.scores(texts), pa.float64()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """Per document: held_out, score and predicted, learnt from the labels of documents that are not held out.

    One row per input row; a null or empty text gets the score of a text without features.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _scored(rows, train(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Ids and scores only: the texts do not travel back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.scores(batch["text"].fillna("").tolist())})

    return in_python(rows, run, "doc_id long, score double")

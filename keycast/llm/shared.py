"""What several corpus operators share: the shared folder and vectorised hashing of words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which all executors reach.

    Only a local master without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local["):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
            place = tempfile.mkdtemp(prefix="keycast-checkpoint-")
        context.setCheckpointDir(place)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession, "unused")  # makes sure that a folder is set
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: compressed, with sizes the planner can see."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; Spark hands the archive to the executors."""
    context = spark.sparkContext
    if any(os.path.basename(str(name)) == "keycast-workers.zip" for name in context._python_includes):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="keycast-"), "keycast-workers.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, "keycast")):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    context.addPyFile(archive)


def exact_frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch as pandas, whole numbers staying whole numbers: beside a null they would turn into floats and lose digits."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        of = column.type
        if pa.types.is_integer(of) and column.null_count:
            out[name] = column.to_pandas(types_mapper={of: pd.Int64Dtype()}.get)
        elif pa.types.is_list(of) and pa.types.is_integer(of.value_type) and column.flatten().null_count:
            out[name] = pd.Series(column.to_pylist(), dtype=object)
        else:
            out[name] = column.to_pandas()
    return pd.DataFrame(out)


def exact_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    """The columns of `schema` from a pandas frame."""
    return pa.RecordBatch.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) for f in schema], schema=schema)


def in_python(df: DataFrame, function, schema: str) -> DataFrame:
    """Like `mapInPandas`, with this package at hand in the workers and whole numbers kept exact beside nulls.

    What a task has taken for its work is given back at its end, since Spark keeps the worker for later tasks.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(exact_frame(batch) for batch in batches):
            if len(frame):
                yield exact_batch(frame, arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bundles(texts: list[str], limit: int = 2_000_000):
    """Slices of `texts` of about `limit` characters, so that arrays built from them stay bounded."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


# -- hashes of words and n-grams ------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The first powers of `base` modulo 2**64, at least `n` of them."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        held[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(held)
    return held


def inverse_powers(n: int) -> np.ndarray:
    """Powers of the base's inverse modulo 2**64 (an odd number has one)."""
    return powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values, in place."""
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def running_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span of symbols (uint64, mixed)."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(len(symbols))[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans; equal spans get equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * inverse_powers(len(prefix))[starts])

"""Token id files: frequency-ranked ids in byte-aligned variable-length codes with separate control bytes.

A file is a Parquet table of blocks, written by Spark so that a lost task
leaves nothing behind. A block holds whole documents in ascending order:

* `ranks`: the ids of the block, most frequent first (little-endian, 4 bytes each);
* `control`: two bits per code, its length in bytes less one, four codes to a byte, lowest bits first;
* `data`: the bytes of the codes, low byte first; a code is the rank of an id;
* `doc_ids`, `lengths`: the documents and their numbers of ids;
* `part`, `block`: the place of the block in the order of the whole.

Ranks are those of the block, whose frequencies are exact and need no pass over
the corpus before; a block reads on its own. Frequent ids take one byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keycast.llm.encoding import MANY, encoder
from keycast.llm.shared import bundles, in_python, shared_folder

BLOCK = "part int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, ranks binary, control binary, data binary"

# Lengths of the four codes of each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ranks, control bytes and data bytes of a block of ids."""
    count = np.bincount(ids)
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count)]
    rank_of = np.zeros(len(count), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    codes = rank_of[ids]
    lengths = 1 + (codes >= 1 << 8).astype(np.uint8) + (codes >= 1 << 16) + (codes >= 1 << 24)
    width = 2 if len(order) <= 1 << 16 else 4
    data = codes.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) < lengths[:, None]]
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = lengths - 1
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(n: int, ranks: bytes, control: bytes, data: bytes) -> np.ndarray:
    """Ids of a block by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    codes = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        codes[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranks, "<u4")[codes]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them in ascending order of id, null ids first, then of a hash of the text.

    Each document gets `end_id` behind its ids; a null text is empty. The one
    shuffle deals texts by ranges of ids; a document is encoded once, on the
    way to its file, and a task holds one block at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, number = encoder(tokenizer, MANY), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.uint32)
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> pd.DataFrame:
            ids = np.concatenate(held)
            ranks, control, data = encode_block(ids)
            return pd.DataFrame({
                "part": [part], "block": [number], "n_tokens": [len(ids)], "doc_ids": [names], "lengths": [[len(x) for x in held]],
                "ranks": [ranks], "control": [control], "data": [data],
            })

        for batch in batches:
            texts = batch["text"].tolist()
            docs_ = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for low, high in bundles(texts, 4_000_000):
                for doc, ids in zip(docs_[low:high], encode.ids(texts[low:high]), strict=True):
                    held.append(np.concatenate((np.frombuffer(ids, encode.dtype).astype(np.uint32), end)))
                    names.append(doc)
                    size += len(held[-1])
                    if size >= block_tokens:
                        yield block()
                        names, held, size, number = [], [], 0, number + 1
        if held:
            yield block()

    in_python(placed.select("doc_id", "text"), blocks, BLOCK).write.option("compression", "none").parquet(path)


def _starts(blocks: DataFrame) -> DataFrame:
    """part, block and the number of ids in all blocks before."""
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per file: their number is that of the writing tasks.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("base"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    table = spark.read.schema(BLOCK).parquet(path)
    blocks = table.join(_starts(table), ["part", "block"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = decode_block(row.n_tokens, row.ranks, row.control, row.data).astype("<u4")
                at, raw, rows = 0, ids.tobytes(), []
                for doc, n in zip(row.doc_ids, row.lengths, strict=True):
                    rows.append((row.base + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
                out = pd.DataFrame(rows, columns=["start", "n_tokens", "ids_crc32"])
                out["doc_id"] = pd.array(list(row.doc_ids), dtype="Int64")
                if with_ids:
                    out["ids"] = np.split(ids.astype(np.int64), np.cumsum(row.lengths)[:-1])
                yield out

    return in_python(blocks, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to files in the shared folder and read their digests back from there."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path, with_ids=False)

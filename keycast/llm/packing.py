"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast.llm.encoding import encoder
from keycast.llm.shared import bundles, in_python, kept, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = f"{PIECES}, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", most: int = 150_000) -> DataFrame:
    """One row per piece of at most `capacity` tokens of a document and its end id.

    A null text is empty (its piece holds the end id alone); a null id stays
    null; repeated rows give repeated pieces; other columns are not read.
    A worker remembers the ids of at most `most` pieces of text.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, most), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for low, high in bundles(texts):
                rows = []
                for doc, ids in zip(batch["doc_id"].iloc[low:high], encode.ids(texts[low:high]), strict=True):
                    ids = np.frombuffer(ids, dtype=encode.dtype).astype("<u4").tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_python(source, cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in `lengths`, each of at most `capacity`.

    A bin takes the largest document that fits, again and again. Then its
    smallest one makes room for two unpacked ones, if some two of them fill
    the gap with it more tightly. Only lengths matter, so the work runs on
    counts per length; `free` has a bit for each length still unpacked.
    """
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    free = sum(1 << n for n in by_length)
    left = {n: len(v) for n, v in by_length.items()}
    under = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]

    def take(n: int) -> None:
        nonlocal free
        left[n] -= 1
        if not left[n]:
            free ^= 1 << n

    def best_pair(room: int) -> tuple[int, int]:
        """The two unpacked lengths with the largest sum within `room`."""
        best, pair = 0, (0, 0)
        a = (free & under[room - 1]).bit_length() - 1 if room > 1 else 0
        while a > 0 and 2 * a > best:
            b = (free & under[min(room - a, a)]).bit_length() - 1
            if b == a and left[a] < 2:
                b = (free & under[a - 1]).bit_length() - 1
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = (free & under[a - 1]).bit_length() - 1
        return pair

    bins = []
    while free:
        room, held = capacity, []
        while (n := (free & under[room]).bit_length() - 1) > 0:
            take(n)
            held.append(n)
            room -= n
        if room and free and len(held) > 1:
            a, b = best_pair(room + held[-1])
            if a + b > held[-1]:
                out = held.pop()
                take(a)
                take(b)
                held += [a, b]
                left[out] += 1
                free |= 1 << out
        bins.append([by_length[n].pop() for n in held])
    return bins


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 30_000) -> DataFrame:
    """Give every piece its sequence and its place there.

    Pieces are dealt evenly by row, whatever their document or length, into
    groups of about `group_rows`; each group is packed on its own and leaves
    at most its last few sequences part-filled. Any number of pieces packs in
    bounded memory. Pieces must have 1 to `capacity` tokens.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    ship(pieces.sparkSession)
    held = kept(pieces.select(*columns))
    groups = max(1, math.ceil(held.count() / group_rows))

    def place(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("_row")
        sequence, offset = np.zeros(len(batch), dtype="int64"), np.zeros(len(batch), dtype="int64")
        lengths, base = batch["length"].to_pylist(), batch["_group"][0].as_py() << 32
        for number, members in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
        # Arrow throughout: beside a null id pandas would turn ids into floats.
        return batch.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # The rows come from files that no longer change, so a row keeps its number when a task runs again.
    numbered = held.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInArrow(place, PLACES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, most: int = 150_000) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, most=most), capacity)

"""Best-fit packing by hierarchical residual rounds.

A document's ids, with the end id, are cut into pieces of CAPACITY ids if there
are more; the piece that comes first takes what doesn't fill one. Full pieces
are sequences of their own. The others are packed best-fit, longest first, within the
partition that encoded them. Bins that are nearly full (NEAR of CAPACITY), or
that have no room for even the smallest bin still open, are emitted; the rest
are items of the next round: each round deals them to fewer tasks, FAN to one,
and packs them best-fit again, until one task has seen what is left. A task packs
ITEMS items at a time at most, whatever the input, so that its memory is bounded;
more than that are never dealt to one task on average. Rounds deal anew each time,
and end after IDLE rounds in a row that merged nothing.

A bin is written as a row (item, bin, offset); bins of bins are resolved by
joins, one for each round. Each round's rows are checkpointed: a bin keeps its
number if an executor is lost.

Null texts count as empty: the end id alone. Repeated rows and ids are packed as
pieces of their own. An empty table gives no pieces. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm.common import checkpointed, written
from docustrata.llm.tokens import CHUNK, END, chunks, crc, default_tokenizer, encoder, lists

CAPACITY = 1024
#: Share of CAPACITY at which a bin is emitted; tasks whose bins meet in one task of the next round; items packed at a time; fruitless rounds.
NEAR, FAN, ITEMS, IDLE = 0.995, 8, 500_000, 3


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each item, fill of each bin: best fit, longest first, equal lengths in the order given."""
    bins, offsets = np.empty(len(lengths), dtype="int64"), np.empty(len(lengths), dtype="int64")
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := there >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r - n:
            room[r - n].append(b)
            there |= 1 << (r - n)
    return bins, offsets, np.array(fill, dtype="int64")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """key, piece, start, length, ids_crc32, ids, and item, a number of the piece. Written, so that numbers stay."""
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 36
        for b in chunks(batches, 1, CHUNK):
            row, piece, start, length, ids = [], [], [], [], []
            for i, x in enumerate(encoder(tokenizer).encode(b.column(1))):
                x = np.append(x, np.uint32(end))
                for k, (s, n) in enumerate(cut(len(x), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    ids.append(x[s : s + n])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([crc(x) for x in ids], pa.int64()), lists(ids), pa.array(range(item, item + len(row)), pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "ids", "item"],
            )
            item += len(row)

    made = docs.select(key, text).mapInArrow(encode, f"key {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, item long")
    return written(made, "pieces")


def packed(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """(item, bin, offset, fill, opens) of items (item, length): each partition best-fit on its own, ITEMS at a time."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (level << 56) | (TaskContext.get().partitionId() << 32)

        def one(held: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal base
            pdf = pd.concat(held).sort_values("item", kind="stable")
            bins, offsets, fill = best_fit(pdf["length"].to_numpy("int64"), capacity)
            base += len(fill)
            return pd.DataFrame({"item": pdf["item"], "bin": base - len(fill) + bins, "offset": offsets, "fill": fill[bins], "opens": offsets == 0})

        held, n = [], 0
        for b in batches:
            for i in range(0, len(b), ITEMS):
                part = b.iloc[i : i + ITEMS]
                if n and n + len(part) > ITEMS:
                    yield one(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield one(held)

    return checkpointed(items.select("item", "length").mapInPandas(pack, "item long, bin long, offset long, fill long, opens boolean"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END, near: float = NEAR, fan: int = FAN) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    made = pieces(docs, key, text, capacity, tokenizer, end)
    part = made.where(F.col("length") < capacity).select("item", "length")
    rounds = [packed(part, capacity, 1)]
    tasks, idle = rounds[0].select(F.shiftright("bin", 32)).distinct().count(), 0
    while idle < IDLE:
        open_ = rounds[-1].where(F.col("opens") & (F.col("fill") < F.lit(int(near * capacity))))
        left, least = open_.agg(F.count("*"), F.min("fill")).first()
        if left < 2 or tasks <= 1:
            break
        items = open_.where(F.col("fill") + F.lit(least) <= capacity).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        tasks = max(1, -(-tasks // fan), -(-left // ITEMS))
        rounds.append(packed(items.repartition(tasks, F.xxhash64("item", F.lit(len(rounds)))), capacity, len(rounds) + 1))
        merged = rounds[-1].agg(F.count("*"), F.count_if("opens")).first()
        idle = idle + 1 if merged[0] == merged[1] else 0
    at = rounds[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for r in rounds[1:]:
        up = r.select(F.col("item").alias("sequence_id"), F.col("bin").alias("__up"), F.col("offset").alias("__by"))
        at = at.join(up, "sequence_id", "left").select("item", F.coalesce("__up", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__by", F.lit(0))).alias("offset"))
    out = made.join(at, "item", "left")
    alone = F.col("length") == capacity  # its own number, in a range that no bin has
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "ids", F.when(alone, F.col("item")).otherwise(F.col("sequence_id")).alias("sequence_id"), F.when(alone, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

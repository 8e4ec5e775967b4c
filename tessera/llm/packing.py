"""Operator 3, packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``capacity`` ids.  The driver sees
only the histogram of piece lengths (at most ``capacity`` numbers): lengths are
placed longest first into the emptiest pack that still takes them, packs being
counted by pattern.  A pattern's slots then take consecutive ranks of their
length, and each piece finds its slot by length and rank.

Null and empty texts are one piece with the end id alone.  Rows that repeat are
packed each for itself; columns of the pieces are kept as they are.  An empty
table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import mapper, texts
from tessera.llm.bpe import byte_bpe
from tessera.llm.bpe_codec import LEAF_CHARS
from tessera.llm.common import materialize, ranked

CAPACITY = 2048
END_ID = 1
#: Slots are broadcast; their number follows from the capacity, not from the data.
MAX_SLOTS = 500_000


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: the ids of each document and its end id, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = byte_bpe(vocabulary)
        row, start, length, total, ids = [], [], [], [], []
        for i, text in enumerate(texts(batch, "text")):
            packed = codec.encode_long(text, leaf_chars) + end
            n = len(packed) // 4
            for a in range(0, n, capacity):
                b = min(n, a + capacity)
                row.append(i)
                start.append(a)
                length.append(b - a)
                total.append(n)
                ids.append(packed[4 * a : 4 * b])
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
            }
        )

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapper(step, "text"), schema)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs have each: shortest pack first, longest length first."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []  # a heap of the negative spaces that have packs

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if not open_packs[space]:
            heapq.heappush(spaces, -space)
        open_packs[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not open_packs[-spaces[0]]:
                heapq.heappop(spaces)
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                pattern, count = open_packs[space].pop()
                used = min(count, left)
                if count > used:
                    open_packs[space].append((pattern, count - used))
                put(space - length, (*pattern, length), used)
                left -= used
            else:  # none takes it: as many in each new pack as go in, as one by one would do
                each = min(capacity // length, left)
                used = left // each
                put(capacity - each * length, (length,) * each, used)
                left -= used * each
    return [pack for packs in open_packs.values() for pack in packs]


def slots(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """``length, from_rank, to_rank, first_sequence, offset``: which ranks of a length fill a slot."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    if len(rows) > MAX_SLOTS:
        raise ValueError(f"{len(rows)} slots are too many to broadcast; the capacity is too large")
    return spark.createDataFrame(rows, "length long, from_rank long, to_rank long, first_sequence long, offset long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length``.

    The pieces are read three times, so they should be a written table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(pieces.sparkSession, pack_histogram(histogram, capacity))
    placed = ranked(pieces, ["length"], ["doc_id", "start"], "_rank")
    return (
        placed.join(F.broadcast(table), "length")
        .where((F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("from_rank"))
        .drop("_rank", "from_rank", "to_rank", "first_sequence")
    )


def packed_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's rows: each piece with its sequence, its offset and the checksum of its ids."""
    pieces = cut_documents(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(materialize(pieces, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

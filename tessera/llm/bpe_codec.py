"""Operator 5, BPE encoding and decoding by tree concatenation.

A long text is cut into halves of halves, the leaves are encoded in parallel
and neighbours are joined level by level: a window around each join is encoded
again and grows until its first ids are the left side's and its last ids the
right side's.  See ``bpe.ByteBpe.encode_long``.

Null and empty texts give no ids and decode to the empty text; rows repeat as
they come, other columns are dropped and a null doc_id stays null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import mapper, texts
from tessera.llm.bpe import byte_bpe

#: Texts with more characters are cut.
LEAF_CHARS = 16_384


def encode_decode(docs: DataFrame, vocabulary: str, leaf_chars: int = LEAF_CHARS, decode: bool = True) -> DataFrame:
    """``doc_id, ids[, decoded]``: packed ids of each whole text, and the text that they decode to."""
    schema = "doc_id long, ids binary" + ", decoded string" * decode

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = byte_bpe(vocabulary)
        ids = [codec.encode_long(text, leaf_chars) for text in texts(batch, "text")]
        columns = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
        if decode:
            columns["decoded"] = pa.array([codec.decode(x) for x in ids], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapper(step, "text"), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from real ids and texts."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

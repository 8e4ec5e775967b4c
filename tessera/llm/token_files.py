"""Operator 6, token-id files: Parquet lists with delta encoding, bounded row groups and page indexes.

Layout: ``bucket=k/part-*.parquet``, one folder for each doc_id range, in
ascending order; within a file rows ascend by doc_id.  ``ids`` is a list of
integers in DELTA_BINARY_PACKED pages (format version 2, dictionary off for
ids), metadata columns stay dictionary encoded.  Row groups and pages are
bounded, and the writer's column and offset indexes let a reader that asks for
a doc_id range or for metadata alone skip the other pages.

Null and empty texts have only the end id.  Null doc_ids come first.  Rows that
share a doc_id follow each other in an order by text hash; identical rows are
interchangeable.  Very long texts are one row each.  An empty table gives an
empty folder; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.arrow import mapper, texts
from tessera.llm.bpe import word_bpe
from tessera.llm.common import bucket_of, new_path, range_bounds, shuffle_partitions

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: A folder beside the buckets, which readers skip for its name: each bucket's greatest doc_id.
BOUNDS = "_bounds"
FILE_SCHEMA = "doc_id long, tie long, n_tokens long, ids array<int>, bucket int"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write them in doc_id order.

    Documents are dealt by doc_id range before they are encoded, so the ids
    are never shuffled, and a lost task encodes its own range again.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()
    buckets = 2 * shuffle_partitions(spark)
    bounds = range_bounds(docs, "doc_id", buckets)
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("bucket", bucket_of("doc_id", bounds))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionById(len(bounds), "bucket")  # a bucket is a task: hashing would deal several to one
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = word_bpe(vocabulary)
        packed = [codec.encode(text) + end for text in texts(batch, "text")]
        sizes = np.array([len(x) // 4 for x in packed], np.int64)
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(sizes), ids, batch.column(2)],
            names=["doc_id", "tie", "n_tokens", "ids", "bucket"],
        )

    (
        dealt.mapInArrow(mapper(step, "text"), FILE_SCHEMA)
        .write.partitionBy("bucket")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary#ids.list.element", "false")
        .option("parquet.column.index.access", "true")
        .parquet(path)
    )
    spark.createDataFrame(list(enumerate(bounds)), "bucket int, last long").coalesce(1).write.parquet(f"{path}/{BOUNDS}")


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows; a doc_id range opens its buckets' folders only, and is pushed down to row groups and pages."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    bounds = sorted(spark.read.parquet(f"{path}/{BOUNDS}").collect()) if first is not None or last is not None else []  # a row for each bucket
    if first is not None:
        df = df.where((F.col("doc_id") >= first) & (F.col("bucket") >= next((r["bucket"] for r in bounds if r["last"] >= first), len(bounds))))
    if last is not None:
        df = df.where((F.col("doc_id") <= last) & (F.col("bucket") <= next((r["bucket"] for r in bounds if r["last"] >= last), len(bounds))))
    return df


def digests(files: DataFrame) -> DataFrame:
    """The contract's columns, from the ids in the files.

    ``start`` adds the ids of the buckets before (one number for each bucket)
    to a running sum within the bucket.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zlib

        ids = batch.column(3)
        values = np.asarray(ids.values).astype("<u4", copy=False)
        offsets = np.asarray(ids.offsets).tolist()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
        sizes = np.diff(np.asarray(ids.offsets)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(4), pa.array(sizes), pa.array(sums, pa.int64())],
            names=["doc_id", "tie", "bucket", "n_tokens", "ids_crc32"],
        )

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                # a copy, so that offsets count from the slice's first value
                yield step(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, 512)]) for c in batch.columns], names=batch.schema.names))

    rows = files.mapInArrow(run, "doc_id long, tie long, bucket int, n_tokens long, ids_crc32 long")
    totals = files.groupBy("bucket").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select(
        "bucket",
        F.coalesce(F.sum("_total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    running = F.sum("n_tokens").over(
        Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", F.coalesce(running, F.lit(0)))
        .join(F.broadcast(before), "bucket")  # a row for each bucket: twice the shuffle partitions at most
        .select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents below the shared folder and answer from the files."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary)
    return digests(read_token_files(docs.sparkSession, path))

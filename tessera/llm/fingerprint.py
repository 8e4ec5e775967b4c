"""Operator 1, document fingerprints: bottom-k sketches of shingle hashes, in SQL functions only.

A sketch is the sorted array of the k least distinct 48-bit hashes of a text's
five-word shingles; a text of one to four words is a single shingle and a text
without words has an empty sketch.  Sketches of parts merge into the sketch of
the whole (``merged``, ``merge_by``), and estimate resemblance, containment and
the number of distinct shingles.  Two texts without words resemble each other
fully; one with and one without don't at all.

Null texts count as empty.  Rows that repeat give rows that repeat; the next
document after several with one doc_id follows an order by text hash, and null
doc_ids come last.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bucket_of, let, range_bounds, shuffle_partitions, words_of

K = 128
WIDTH = 5
HASH_BITS = 48
HEX_DIGITS = HASH_BITS // 4


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k least distinct hashes of the text's shingles, ascending."""
    cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)

    def of(w: Column) -> Column:
        n = F.size(w)
        whole = F.array(cut(F.xxhash64(F.array_join(w, " "))))
        each = F.transform(F.sequence(F.lit(0), n - width), lambda i: cut(F.xxhash64(*[F.get(w, i + j) for j in range(width)])))
        hashes = F.when(n >= width, each).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return let(words_of(text), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """``key, sketch``: the sketch of each group's rows.

    Hashes are deduplicated and ranked with a limit before the shuffle, so a
    group of any size sends k hashes from each task.
    """
    hashes = df.select(key, F.explode(column).alias("h")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("_r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles; exact where neither sketch is full."""
    full = (F.size(a) >= k) | (F.size(b) >= k)
    union = let(F.array_union(a, b), lambda u: F.when(full, F.slice(F.sort_array(u), 1, k)).otherwise(u))
    ratio = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(ratio)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string of fixed-width hexadecimal hashes."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HEX_DIGITS, "0")), "")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the next row by descending doc_id; the last row's next is the first.

    Rows are dealt into ranges of doc_id; each range also gets the greatest
    row of the range below, and the lowest range the greatest of all, so that
    every row meets its next one in one shuffle.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", 4 * shuffle_partitions(spark))
    last = len(bounds) - 1
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    top = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    placed = docs.withColumn("_bucket", bucket_of("doc_id", bounds))
    above = F.when(F.col("_bucket") == last, F.lit(0)).otherwise(F.col("_bucket") + 1)
    home = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(above.alias("bucket"), F.lit(True).alias("guest"))
    is_top = key == F.get(top, F.col("_bucket"))
    dealt = placed.withColumn("_at", F.explode(F.when(is_top, F.array(home, guest)).otherwise(F.array(home))))
    window = Window.partitionBy("_at.bucket").orderBy("_at.guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried})
    return found.where(~F.col("_at.guest")).drop("_at", "_bucket")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Each text, its edited text and both sketches, with the sketch of the next text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(own, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    return rows.withColumn("edited_sketch", sketch(F.col("edited")))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

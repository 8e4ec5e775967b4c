"""Global order without one task for all rows: ranges of a key, and places within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOW = -(1 << 63)


def bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds of a whole-number column, the last its maximum; nulls are lowest.

    One aggregate over one narrow column; the bounds are all the driver sees.
    """
    key = F.coalesce(F.col(column).cast("long"), F.lit(_LOW))
    shares = [i / buckets for i in range(1, buckets)] or [1.0]
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), max(10_000, 10 * buckets)).alias("q"), F.max(key).alias("top")).head()
    return [0] if row is None or row["top"] is None else sorted({*row["q"], row["top"]})


def bucket(column: str, ends: list[int]) -> Column:
    """The number of the first bound not below the value, by binary search in the JVM."""
    key = F.coalesce(F.col(column).cast("long"), F.lit(_LOW))
    table = F.array(*[F.lit(int(b)).cast("long") for b in ends])

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.get(table, middle) < state["key"]
        low, high = F.when(below, middle + 1).otherwise(state["low"]), F.when(below, state["high"]).otherwise(middle)
        return F.when(state["low"] >= state["high"], state).otherwise(F.struct(low.alias("low"), high.alias("high"), state["key"].alias("key")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(ends) - 1).alias("high"), key.alias("key"))
    return F.aggregate(F.array_repeat(F.lit(0), max(1, len(ends).bit_length())), start, halve, lambda s: s["low"])


def placed(df: DataFrame, key: str, tie: list[str], out: str = "ord") -> DataFrame:
    """Add each row's place from 0 in the order of ``key, *tie``.

    Rows go to ranges of the key in one shuffle and are numbered there; only
    the ranges' counts, a few for each shuffle partition, meet in one task.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_range", bucket(key, bounds(df, key, parts)))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key, *tie)) - 1
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")

"""Cross references: votes by target, and items for spans in first-seen order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cross references shown.
TOP = 20


def top_targets(refs: DataFrame, source: str, target: str, seen: str, previews: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` targets of each source with the most votes in all; ties by first seen.

    Targets without a preview (``target, preview``) go after their votes are
    summed.  The rank has a limit, so each task sends ``k`` rows of a source.
    """
    sums = refs.groupBy(source, target).agg(F.sum("votes").alias("votes"), F.min(seen).alias("_seen")).join(previews, target)
    w = Window.partitionBy(source).orderBy(F.desc("votes"), "_seen", target)
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_seen")


def outside(refs: DataFrame, first: str, last: str, span_first: str, span_last: str) -> DataFrame:
    """References whose target isn't wholly inside their own span."""
    return refs.where(~((F.col(first) >= F.col(span_first)) & (F.col(last) <= F.col(span_last))))


def first_seen(rows: DataFrame, key: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Distinct ``key`` of each ``by``, numbered in first-seen order."""
    seen = rows.groupBy(*by, *key).agg(F.min(F.struct(*order)).alias("_first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_first", *key)) - 1).drop("_first")

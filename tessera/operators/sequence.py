"""Sequences: consecutive pairs, timelines, placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import timeline
from tessera.operators import ranges


def steps(rows: DataFrame, chain: list[str], item: str, order: list[str | Column]) -> DataFrame:
    """``prior, next`` of consecutive items; a lone item has no step."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return rows.select(*chain, F.col(item).alias("prior"), F.lead(item).over(w).alias("next")).where("next is not null")


def neighbours(rows: DataFrame, chain: list[str], item: str, order: list[str | Column]) -> DataFrame:
    """Each item with the one before and the one after."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return rows.select(*chain, item, F.lag(item).over(w).alias("earlier"), F.lead(item).over(w).alias("later"))


def timeline_order(events: DataFrame, year: str, tie: list[str], place: str = "seq") -> DataFrame:
    """Add each event's place in the whole timeline, from 0.

    ``year`` may be any whole number that orders events, such as a day: the
    finer it is, the more evenly rows are dealt.
    """
    return ranges.placed(events, year, tie, place)


def placements(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """``event, basis, year``: an own anchor, else the predecessor of the narrative, else the one before in the timeline, else the era alone.

    ``events``: event, narrative, seq, from_year; ``anchors``: event, anchor_year.
    """
    leg = F.lag("from_year").over(Window.partitionBy("narrative").orderBy("seq"))
    known = events.join(anchors, "event", "left").withColumn("leg_year", leg)
    basis = F.when(F.col("anchor_year").isNotNull(), "anchor").when(F.col("leg_year").isNotNull(), "narrative").otherwise("era")
    return known.select("event", basis.alias("basis"), F.coalesce("anchor_year", "leg_year").cast("int").alias("year"))


def resolve(anchor: Column, offset: Column, reign: Column, nth: Column, prior: Column, spacing: Column) -> Column:
    """The year of a placement: anchor plus offset, reign plus n - 1, prior plus spacing, or none."""
    return F.coalesce(timeline.add_years(anchor, offset), timeline.add_years(reign, nth - 1), timeline.add_years(prior, spacing))


def suffixed(rows: DataFrame, slug: str, order: list[str], out: str = "id") -> DataFrame:
    """Ids of equal slugs: the slug, then with ``-2``, ``-3`` in order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def latest(rows: DataFrame, key: str, priority: list[Column]) -> DataFrame:
    """One row for each key, the first by priority: later sources replace earlier ones."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*priority))).where("_r = 1").drop("_r")


def without_repeats(rows: DataFrame, by: list[str], item: str, order: list[str]) -> DataFrame:
    """Items that differ from the one before: only neighbouring repeats go."""
    before = F.lag(item).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_b", before).where(~F.col(item).eqNullSafe(F.col("_b"))).drop("_b")

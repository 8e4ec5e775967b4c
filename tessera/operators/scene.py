"""Scenes: what is lit in a window, what is quiet, which steps join it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import timeline

#: Greatest brightness, and verses shown of a group.
BRIGHTEST, GROUP_VERSES = 5, 20


def in_window(events: DataFrame, first: int, last: int) -> DataFrame:
    """Events whose range meets the window, both ends counted; a bad window is refused."""
    first, last = timeline.check_window(first, last)
    return events.where(timeline.intersects(F.col("from_year"), F.col("to_year"), F.lit(first), F.lit(last)))


def lit(events: DataFrame, first: int, last: int) -> DataFrame:
    """``place, n_events, brightness``: places with an event in the window, each event once."""
    found = in_window(events, first, last).groupBy("place").agg(F.count(F.lit(1)).alias("n_events"))
    return found.withColumn("brightness", F.least(F.col("n_events"), F.lit(BRIGHTEST)).cast("int"))


def quiet(events: DataFrame, first: int, last: int) -> DataFrame:
    """``place, total_events``: places with events, none of them in the window: one aggregate."""
    first, last = timeline.check_window(first, last)
    meets = timeline.intersects(F.col("from_year"), F.col("to_year"), F.lit(first), F.lit(last))
    counts = events.groupBy("place").agg(F.count(F.lit(1)).alias("total_events"), F.count_if(meets).alias("inside"))
    return counts.where("inside = 0").select("place", "total_events")


def arrows(events: DataFrame, first: int, last: int, order: list[str | Column]) -> DataFrame:
    """``narrative, order, from_place, to_place, from_event, to_event``: steps of each narrative in the window.

    The number counts every consecutive pair that is kept; pairs at one place
    are left out afterwards, so numbers have gaps.
    """
    w = Window.partitionBy("narrative").orderBy(*order)
    steps = in_window(events, first, last).select(
        "narrative",
        F.row_number().over(w).alias("order"),
        F.col("place").alias("from_place"),
        F.lead("place").over(w).alias("to_place"),
        F.col("event").alias("from_event"),
        F.lead("event").over(w).alias("to_event"),
    )
    return steps.where(F.col("to_event").isNotNull() & (F.col("from_place") != F.col("to_place")))


def legend(events: DataFrame, arrows_: DataFrame, first: int, last: int) -> DataFrame:
    """``narrative, legs_in_scene`` of narratives with an arrow."""
    legs = in_window(events, first, last).groupBy("narrative").agg(F.count(F.lit(1)).alias("legs_in_scene"))
    return legs.join(arrows_.select("narrative").distinct(), "narrative", "left_semi")


def verse_groups(verses: DataFrame, matched: Column, by: list[str], cap: int = GROUP_VERSES) -> DataFrame:
    """Groups of verses: at most ``cap`` of each, matched ones first, in order, and the full count."""
    ranked = verses.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(matched.cast("int").desc(), "verse")))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_r") <= cap, F.col("verse")))), ",").alias("verses"),
    )


def display_names(places: DataFrame, names: DataFrame, aliases: DataFrame, first: int, last: int) -> DataFrame:
    """``place, display_name``: the period name that covers the window's middle, else the latest in the window, else the alias, else the default without its number.

    ``names``: place, name, from_year, to_year; ``aliases``: place, alias.
    """
    first, last = timeline.check_window(first, last)
    middle = timeline.midpoint(F.lit(first), F.lit(last))
    near = names.where(timeline.intersects(F.col("from_year"), F.col("to_year"), F.lit(first), F.lit(last)))
    rank = F.struct(timeline.contains_year(F.col("from_year"), F.col("to_year"), middle).cast("int").alias("c"), F.col("from_year").alias("f"), F.col("name").alias("n"))
    period = near.groupBy("place").agg(F.max(rank).alias("m")).select("place", F.col("m.n").alias("period_name"))
    return (
        places.join(period, "place", "left")
        .join(aliases, "place", "left")
        .select("place", F.coalesce("period_name", "alias", F.regexp_replace("name", r" \d+$", "")).alias("display_name"))
    )

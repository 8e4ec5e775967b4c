"""Laws as violation tables: ``law, subject, detail``; no row, no violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import timeline


def violations(df: DataFrame, law: str, subject: str | Column, detail: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(law).alias("law"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(F.col(key).alias(column)), column, "left_anti")


#: Years of a cell of eras.
CELL = 100


def era_gaps(eras: DataFrame, first: int, last: int) -> DataFrame:
    """``era, problem``: each era starts in the year after the last one's end, the first and last at the span's ends.

    ``eras``: era, from_year, to_year.  Neighbours are found within cells of
    years; a cell's first era follows the last one of the cells before, of
    which there is a row for each cell.
    """
    order = F.struct("from_year", "era")
    celled = eras.withColumn("cell", F.floor(F.col("from_year") / CELL))
    ends = celled.groupBy("cell").agg(F.max_by("to_year", order).alias("end"))
    over = Window.orderBy("cell")  # a row for each cell
    ends = ends.withColumns({"before": F.lag("end").over(over), "final": F.lead("cell").over(over).isNull()}).drop("end")
    w = Window.partitionBy("cell").orderBy("from_year", "era")
    marked = celled.withColumns({"prev": F.lag("to_year").over(w), "next": F.lead("from_year").over(w)}).join(ends, "cell")
    marked = marked.withColumn("prev", F.coalesce("prev", "before"))
    due = timeline.next_year(F.col("prev"))
    problem = (
        F.when(~timeline.valid_range(F.col("from_year"), F.col("to_year")), "range")
        .when(F.col("prev").isNull() & (F.col("from_year") != first), "start")
        .when(F.col("from_year") > due, "gap")
        .when(F.col("from_year") < due, "overlap")
        .when(F.col("next").isNull() & F.col("final") & (F.col("to_year") != last), "end")
    )
    return marked.select("era", problem.alias("problem")).where("problem is not null")


def overlaps(df: DataFrame, by: str, key: str, first: str, last: str) -> DataFrame:
    """Pairs of ranges of one group that overlap, found against the furthest range before."""
    w = Window.partitionBy(by).orderBy(first, last, key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_reach", F.max(last).over(w)).where(F.col(first) <= F.col("_reach")).drop("_reach")


def backwards(df: DataFrame, chain: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is below that of the row before in their chain."""
    before = F.lag(value).over(Window.partitionBy(chain).orderBy(*order))
    return df.withColumn("before", before).where(F.col(value) < F.col("before"))


def outside_window(events: DataFrame, windows: DataFrame, by: str) -> DataFrame:
    """Events outside the window of their group, or without one: ``windows`` has ``by, w_first, w_last``."""
    met = events.join(windows, by, "left")
    problem = F.when(F.col("w_first").isNull(), "missing").when((F.col("from_year") < F.col("w_first")) | (F.col("to_year") > F.col("w_last")), "outside")
    return met.withColumn("problem", problem).where("problem is not null")


def anchor_status(anchors: DataFrame, events: DataFrame, deferred: DataFrame) -> DataFrame:
    """Anchors against event years: ``ok``, ``mismatch``, ``deferred``, ``stale`` (a deferral that isn't needed) or ``missing``."""
    met = anchors.join(events.select("event", "from_year"), "event", "left").join(deferred.select("event", F.lit(True).alias("_d")), "event", "left")
    same, put_off = F.col("from_year") == F.col("anchor_year"), F.coalesce("_d", F.lit(False))
    status = F.when(F.col("from_year").isNull(), "missing").when(same & put_off, "stale").when(same, "ok").when(put_off, "deferred").otherwise("mismatch")
    return met.select("event", status.alias("status"))


def same_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with their multiplicity: none if they are the same."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def calibrated(events: DataFrame, shift: int = 3) -> DataFrame:
    """Imported years after Christ moved by a fixed number of years; not idempotent."""
    moved = lambda c: F.when((F.col("from_year") > 0), F.col(c) + shift).otherwise(F.col(c)).cast("int")
    return events.withColumns({"from_year": moved("from_year"), "to_year": moved("to_year")})


def overridden(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Years replaced by overrides ``event, new_from, new_to``, with the years before."""
    met = events.join(overrides, "event", "left")
    return met.select("event", F.col("from_year").alias("before"), F.coalesce("new_from", "from_year").alias("from_year"), F.coalesce("new_to", "to_year").alias("to_year"), F.col("new_from").isNotNull().alias("changed"))

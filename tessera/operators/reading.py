"""Reading order: spines, windows, runs, headings, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import ranges

#: Units in a window unless asked, the most of them, and how far a chapter is probed.
WINDOW, MAX_WINDOW, CHAPTER_PROBE = 1, 500, 200


def spine(units: DataFrame, chapter: str = "chapter", verse: str = "verse") -> DataFrame:
    """Add ``ord``, each unit's place in the whole order by chapter and verse, from 0."""
    return ranges.placed(units, chapter, [verse])


def clamp(n: object, default: int = WINDOW, most: int = MAX_WINDOW) -> int:
    """A count as asked: unreadable is the default, outside is clamped."""
    try:
        return max(1, min(int(str(n)), most))
    except ValueError:
        return default


def window(ordered: DataFrame, start: int, n: int, backward: bool = False) -> DataFrame:
    """``n`` units from a place; backward the window ends there, but never begins before 0."""
    if n <= 0:
        return ordered.limit(0)
    first = max(0, start - (n - 1)) if backward else start
    return ordered.where(F.col("ord").between(first, first + n - 1))


def next_place(start: int, n: int, total: int, backward: bool = False) -> int | None:
    """One past the window in its direction, if there is a unit."""
    at = max(0, start - (n - 1)) - 1 if backward else start + n
    return at if 0 <= at < total else None


def chapter_spans(ordered: DataFrame, chapter: str = "chapter") -> DataFrame:
    """``chapter, first_ord, n_units``."""
    return ordered.groupBy(chapter).agg(F.min("ord").alias("first_ord"), F.least(F.count(F.lit(1)), F.lit(CHAPTER_PROBE)).alias("n_units"))


def runs(verses: DataFrame, by: list[str], chapter: str = "chapter", verse: str = "verse", ends: DataFrame | None = None) -> DataFrame:
    """Runs of neighbouring verses: first and last of each, and how many.

    Neighbours are consecutive verses of one chapter or, where ``ends``
    (``chapter, last_verse``) is given, a chapter's last verse and the next
    chapter's first.  Repeated verses count once.
    """
    w = Window.partitionBy(*by).orderBy(chapter, verse)
    rows = verses.select(*by, chapter, verse).distinct()
    if ends is not None:
        rows = rows.join(ends, chapter, "left")
    before_c, before_v = F.lag(chapter).over(w), F.lag(verse).over(w)
    near = (before_c == F.col(chapter)) & (before_v + 1 == F.col(verse))
    if ends is not None:
        near = near | ((before_c + 1 == F.col(chapter)) & (F.col(verse) == 1) & (before_v == F.lag("last_verse").over(w)))
    marked = rows.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    at = F.struct(F.col(chapter).alias("c"), F.col(verse).alias("v"))
    out = marked.groupBy(*by, "_run").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n_verses"))
    return out.select(*by, F.col("a.c").alias("from_chapter"), F.col("a.v").alias("from_verse"), F.col("b.c").alias("to_chapter"), F.col("b.v").alias("to_verse"), "n_verses")


def merged_ranges(ranges: DataFrame, by: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """Ranges of whole numbers merged where they overlap or touch."""
    w = Window.partitionBy(*by).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(*by, first, last).distinct().withColumn("_new", F.when(F.col(first) <= reach + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def passages(found: DataFrame) -> DataFrame:
    """Runs of two verses or more in one chapter."""
    return found.where((F.col("from_chapter") == F.col("to_chapter")) & (F.col("n_verses") >= 2))


def heading_winners(candidates: DataFrame, unit: list[str]) -> DataFrame:
    """One heading for each unit: openers before continuations, then layer, kind, the earlier year, the earlier seq, the smaller id."""
    w = Window.partitionBy(*unit).orderBy("is_continuation", F.desc("layer"), F.desc("kind_rank"), "year", "seq", "heading")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contents(ordered: DataFrame, group: Column, chapter: str = "chapter") -> DataFrame:
    """``grp, n_chapters, n_units, first_ord``: the upper level of a two-level table of contents."""
    return ordered.groupBy(group.alias("grp")).agg(F.count_distinct(chapter).alias("n_chapters"), F.count(F.lit(1)).alias("n_units"), F.min("ord").alias("first_ord"))


def segments(spans: DataFrame, by: list[str]) -> DataFrame:
    """Pieces between all cut points of overlapping spans ``start, end``, with the number of spans on each."""
    cuts = spans.select(*by, F.explode(F.array("start", "end")).alias("start")).distinct()
    pieces = cuts.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("start"))).where("end is not null")
    cover = spans.withColumnsRenamed({"start": "s", "end": "e"})
    return pieces.join(cover, by).where((F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end"))).groupBy(*by, "start", "end").agg(F.count(F.lit(1)).alias("n_spans"))

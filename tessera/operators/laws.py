"""Laws of curated data as violation tables, and the joins that refuse what they forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo

#: Translation that every witness must have.
TRANSLATION = "kjv"


def _law(df: DataFrame, law: str, *subject: str) -> DataFrame:
    return df.select(F.lit(law).alias("law"), F.concat_ws("/", *[F.col(c).cast("string") for c in subject]).alias("subject"))


def resolved(translations: Column, code: str = TRANSLATION) -> Column:
    """The entry of a translation, by its exact code; an unknown code is an error."""
    return F.coalesce(F.try_element_at(translations, F.lit(code)), F.raise_error(F.lit(f"unknown translation {code}")))


def temporal_key(first: str, last: str, seq: str) -> list[Column]:
    """Order of placements: first year, last year, place in the sequence; none comes before some."""
    return [F.col(c).asc_nulls_first() for c in (first, last, seq)]


def witness_violations(witnesses: DataFrame, books: DataFrame, tops: DataFrame) -> DataFrame:
    """``law, subject`` of witnesses ``event, n, book, verses`` against known ``book`` and the books of events' own verses ``event, book``.

    A witness has a known book, the default translation (``verses`` isn't null)
    and a verse; two witnesses of one event and book have no common verse; once
    an event has a witness, each book of its own verses has one.
    """
    unknown = witnesses.join(books.select("book").distinct(), "book", "left_anti")
    verses = witnesses.select("event", "book", "n", F.explode(F.array_distinct("verses")).alias("verse"))
    shared = verses.groupBy("event", "book", "verse").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("event", "book").distinct()
    having = witnesses.select("event", "book").distinct()
    bare = tops.select("event", "book").distinct().join(having.select("event").distinct(), "event", "left_semi").join(having, ["event", "book"], "left_anti")
    return (
        _law(unknown, "unknown-book", "event", "n")
        .unionByName(_law(witnesses.where("verses is null"), "no-translation", "event", "n"))
        .unionByName(_law(witnesses.where("size(verses) = 0"), "no-verse", "event", "n"))
        .unionByName(_law(shared, "common-verse", "event", "book"))
        .unionByName(_law(bare, "no-witness", "event", "book"))
    )


def boundary_violations(events: DataFrame, boundaries: list[tuple[str, int, int]]) -> DataFrame:
    """``event, boundary, side`` of events on the wrong side of a boundary ``id, year, pos``.

    ``events``: event, pos, first and last year of its books' windows, null if
    a book has none.  Windows that all end at or before the year put the event
    there, windows that all start later put it after; others assert nothing.
    The boundaries are a parameter.
    """
    marks = F.array(*[F.struct(F.lit(b).alias("boundary"), F.lit(y).alias("year"), F.lit(p).alias("at")) for b, y, p in boundaries])
    met = events.select("event", "pos", "w_first", "w_last", F.explode(marks).alias("b")).select("*", "b.*")
    before, after = F.col("w_last") <= F.col("year"), F.col("w_first") > F.col("year")
    side = F.when(before & ~after & (F.col("pos") > F.col("at")), "before").when(after & ~before & (F.col("pos") <= F.col("at")), "after")
    return met.where(F.col("pos") != F.col("at")).select("event", "boundary", side.alias("side")).where("side is not null")


def merge_violations(merges: DataFrame, places: DataFrame, limit: float = geo.SAME_PLACE_KM) -> DataFrame:
    """``law, subject`` of merges ``survivor, absorbed``: both are places ``id, lat, lon`` and no farther apart than the limit."""
    spot = lambda c: places.select(F.col("id").alias(c), F.struct("lat", "lon").alias(f"_{c}"))
    met = merges.join(spot("survivor"), "survivor", "left").join(spot("absorbed"), "absorbed", "left")
    km = geo.haversine_km(F.col("_survivor.lat"), F.col("_survivor.lon"), F.col("_absorbed.lat"), F.col("_absorbed.lon"))
    return (
        _law(met.where("_survivor is null"), "no-survivor", "survivor", "absorbed")
        .unionByName(_law(met.where("_absorbed is null"), "no-absorbed", "survivor", "absorbed"))
        .unionByName(_law(met.where(km > limit), "too-far", "survivor", "absorbed"))
    )


def place_name_violations(names: DataFrame, places: DataFrame, verses: DataFrame, first: int, last: int) -> DataFrame:
    """``law, subject`` of place names ``place, name, from_year, to_year, verses``: known place, years in the span, ranges of a place apart, known verses."""
    from tessera.operators import rules

    ranged = names.withColumn("key", F.col("name"))
    cited = names.select("place", "name", F.explode("verses").alias("verse"))
    return (
        _law(names.join(places.select("place").distinct(), "place", "left_anti"), "unknown-place", "place", "name")
        .unionByName(_law(names.where((F.col("from_year") < first) | (F.col("to_year") > last) | (F.col("from_year") > F.col("to_year"))), "years", "place", "name"))
        .unionByName(_law(rules.overlaps(ranged, "place", "key", "from_year", "to_year"), "overlap", "place", "name"))
        .unionByName(_law(cited.join(verses.select("verse").distinct(), "verse", "left_anti").distinct(), "unknown-verse", "place", "name"))
    )


def alias_violations(aliases: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """``law, subject`` of aliases ``id, name, verses``: once each, other than the place's own name, and in every verse ``verse, text`` that it cites.

    Long dashes count as hyphens; a bracketed end doesn't belong to a place's name.
    """
    plain = lambda c: F.regexp_replace(c, "[–—]", "-")
    own = places.select("id", F.trim(F.regexp_replace("name", r"\s*\([^)]*\)\s*$", "")).alias("own"))
    cited = aliases.select("id", "name", F.explode("verses").alias("verse")).join(texts, "verse", "left")
    return (
        _law(aliases.groupBy("id", "name").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated", "id", "name")
        .unionByName(_law(aliases.join(own, "id").where("name = own").select("id", "name").distinct(), "own-name", "id", "name"))
        .unionByName(_law(cited.where(~F.coalesce(F.contains(plain(F.col("text")), plain(F.col("name"))), F.lit(False))).select("id", "name", "verse"), "not-in-verse", "id", "name", "verse"))
    )


def catechism_violations(parts: DataFrame, items: DataFrame, verses: DataFrame) -> DataFrame:
    """``law, subject`` of parts ``part`` and items ``part, item, verses``: item ids are unique, no part is empty, every item cites a known verse."""
    known = items.select("item", F.explode("verses").alias("verse")).join(verses.select("verse").distinct(), "verse", "left_semi").select("item").distinct()
    return (
        _law(items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated-item", "item")
        .unionByName(_law(parts.join(items.select("part").distinct(), "part", "left_anti"), "empty-part", "part"))
        .unionByName(_law(items.select("item").distinct().join(known, "item", "left_anti"), "no-verse", "item"))
    )


def span_violations(rows: DataFrame) -> DataFrame:
    """``edge_id, n_spans``: citation edges whose rows ``edge_id, span`` have more than one span."""
    return rows.groupBy("edge_id").agg(F.count_distinct("span").alias("n_spans")).where("n_spans > 1")


def attached(rows: DataFrame, details: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Rows with the details of their key; details of an unknown key are an error, unless they aren't checked."""
    if check:
        stray = details.join(rows.select(key), key, "left_anti").select(key).head()
        if stray is not None:
            raise ValueError(f"details of an unknown {key}: {stray[0]}")
    return rows.join(details, key, "left")


def united(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; a key that both have is an error."""
    met = a.select(key).join(b.select(key), key, "left_semi").head()
    if met is not None:
        raise ValueError(f"both sources have {key} {met[0]}")
    return a.unionByName(b)


def succession_steps(succession: DataFrame, steps: DataFrame) -> DataFrame:
    """``succession, steps``: the steps' nodes of each succession in their order, joined by commas."""
    met = succession.join(steps, "succession")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "node"))), lambda s: s["node"].cast("string"))
    return met.groupBy("succession").agg(F.array_join(ordered, ",").alias("steps"))


def words_covering(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """``text_id, start, end, first, last``: the tokens ``text_id, ord, start, end`` of character ranges; null unless both ends are tokens' ends."""
    begin = tokens.select("text_id", "start", F.col("ord").alias("first"))
    end = tokens.select("text_id", "end", F.col("ord").alias("last"))
    met = ranges.join(begin, ["text_id", "start"], "left").join(end, ["text_id", "end"], "left")
    whole = F.col("first") <= F.col("last")
    return met.select("text_id", "start", "end", F.when(whole, F.col("first")).alias("first"), F.when(whole, F.col("last")).alias("last"))

"""Scans of raw and curated sources.

Schemas are given, never inferred.  Lines and elements carry their place
(``ord``), since first-seen order decides in several scans.  Scans that drop
rows return the counts with the rows, as conditional sums over the same input.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import refs, text, timeline
from tessera.operators.sequence import suffixed


class SourceError(ValueError):
    """A source that breaks its closed vocabulary."""


def _book_codes(which: int) -> Column:
    """Names of books (0 code, 1 short name, 2 name) to their numbers."""
    return F.create_map(*[F.lit(x) for i, b in enumerate(refs.BOOKS) for x in (b[which].replace("_", " "), i)])


def osis(verse: Column) -> Column:
    """``Gen.1.1`` as a struct ``book, chapter, verse``; null if it doesn't parse."""
    part = lambda k: F.regexp_extract(verse, r"^([0-9A-Za-z]+)\.(\d{1,5})\.(\d{1,5})$", k)
    book = F.element_at(_book_codes(1), part(1))
    found = F.struct(book.alias("book"), part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("verse"))
    return F.when(book.isNotNull(), found)


def dot_ref(at: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for code, i in refs.BOOK_INDEX.items() for x in (i, code)])
    return F.concat_ws(".", F.element_at(codes, at["book"]), at["chapter"].cast("string"), at["verse"].cast("string"))


# ---------------------------------------------------------------- texts

_CANON = "translation string, books array<struct<name:string, chapters:array<struct<chapter:int, verses:array<struct<verse:int, text:string>>>>>>"


def canon_json(spark: SparkSession, path: str) -> DataFrame:
    """``book, chapter, verse, text`` of nested books; an unknown book is an error."""
    nested = spark.read.schema(_CANON).json(path, multiLine=True)
    books = nested.select(F.explode("books").alias("b"))
    named = books.select(F.element_at(_book_codes(2), F.col("b.name")).alias("book"), "b")
    checked = named.withColumn("book", F.coalesce("book", F.raise_error(F.concat(F.lit("unknown book "), "b.name")).cast("int")))
    chapters = checked.select("book", F.explode("b.chapters").alias("c"))
    return chapters.select("book", "c.chapter", F.explode("c.verses").alias("v")).select("book", "chapter", "v.verse", "v.text")


def editions(spark: SparkSession, folder: str) -> DataFrame:
    """``edition, book, chapter, verse, text`` of a folder of chapter files ``<edition>/<BOOK>/<chapter>.json``."""
    rows = spark.read.schema("verses array<struct<verse:int,text:string>>").json(f"{folder}/*/*/*.json", multiLine=True).withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", r"([^/]+)/([^/]+)/(\d+)\.json$", k)
    named = rows.select(part(1).alias("edition"), F.element_at(_book_codes(0), part(2)).alias("book"), part(3).cast("int").alias("chapter"), F.explode("verses").alias("v"))
    return named.select("edition", "book", "chapter", "v.verse", "v.text")


# ---------------------------------------------------------------- cross references

def cross_references(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``from, to, to_last, votes, rank`` (rank by votes, then by line, within a source), and counts of what was dropped.

    Lines that don't parse or haven't three fields, and verses that cite themselves alone, go.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    fields = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.lower("value").startswith("from")).select("line", F.split("value", "\t").alias("f"))
    raw = fields.select("line", (F.size("f") == 3).alias("three"), F.get("f", 0).alias("source"), F.get("f", 1).alias("target"), F.trim(F.get("f", 2)).alias("votes"))
    first, last = F.split_part("target", F.lit("-"), F.lit(1)), F.split_part("target", F.lit("-"), F.lit(2))
    parsed = raw.select("line", "three", osis(F.col("source")).alias("from"), osis(first).alias("to"), F.when(last != "", osis(last)).alias("to_last"), F.col("votes").try_cast("int").alias("votes"), (last == "").alias("single"))
    bad = ~F.col("three") | F.col("from").isNull() | F.col("to").isNull() | F.col("votes").isNull() | (~F.col("single") & F.col("to_last").isNull())
    own = F.coalesce(F.col("single") & (F.col("from") == F.col("to")), F.lit(False))
    counts = parsed.agg(F.count_if(bad).alias("unparseable"), F.count_if(~bad & own).alias("self_references"), F.count_if(~bad & ~own).alias("kept"))
    kept = parsed.where(~bad & ~own).drop("single", "three")
    rank = F.row_number().over(Window.partitionBy("from").orderBy(F.desc("votes"), "line"))
    return kept.withColumn("rank", rank).drop("line"), counts


def with_known_targets(references: DataFrame, verses: DataFrame) -> DataFrame:
    """References whose first target is a verse of the corpus (``book, chapter, verse``)."""
    known = verses.select(F.struct("book", "chapter", "verse").alias("to"))
    return references.join(known, "to", "left_semi")


# ---------------------------------------------------------------- places, events, people

_GEO = (
    "friendly_id string, identifications array<struct<resolutions:array<struct<lonlat:string,modern_basis_id:string>>>>, "
    "modern_associations map<string,struct<name:string,score:int,url_slug:string>>, verses array<struct<osis:string,translations:array<string>>>"
)
#: A verse counts for a place where this translation names it.
TRANSLATION = "kjv"


def places_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, lat, lon, verses``: the coordinate with the best association, the first of equals; no coordinate, no place.

    Equal slugs get ``-2``, ``-3`` by line.
    """
    lines = spark.read.schema(_GEO).json(path).withColumn("line", F.monotonically_increasing_id())
    spots = lines.select("line", "modern_associations", F.posexplode("identifications").alias("i", "ident")).select("line", "modern_associations", "i", F.posexplode("ident.resolutions").alias("j", "r"))
    score = F.coalesce(F.col("modern_associations")[F.col("r.modern_basis_id")]["score"], F.lit(0))
    best = spots.where(F.col("r.lonlat").isNotNull()).groupBy("line").agg(F.max_by("r.lonlat", F.struct(score.alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("lonlat"))
    part = lambda k: F.split_part("lonlat", F.lit(","), F.lit(k)).try_cast("double")
    named_there = F.filter(F.coalesce("verses", F.array()), lambda v: F.coalesce(F.array_contains(v["translations"], TRANSLATION), F.lit(False)))
    verses = F.array_distinct(F.filter(F.transform(named_there, lambda v: dot_ref(osis(v["osis"]))), lambda v: v.isNotNull() & (v != "")))
    named = lines.join(best, "line").select("line", F.col("friendly_id").alias("name"), part(2).alias("lat"), part(1).alias("lon"), verses.alias("verses"), text.slug(F.col("friendly_id")).alias("slug"))
    return suffixed(named, "slug", ["line"]).select("id", "name", "lat", "lon", "verses", "line")


_EVENTS = "id string, fields struct<title:string, startDate:string, duration:string, locations:array<string>, verses:array<string>, eventID:int>"
_PLACE_RECORDS = "id string, fields struct<displayTitle:string, kjvName:string, latitude:string, longitude:string, slug:string>"
_VERSES = "id string, fields struct<osisRef:string>"


def events_json(spark: SparkSession, events: str, place_records: str, verse_records: str, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated events ``id, label, year, places, verses``, and places made for names that no known place has.

    Places join by lower-case name, the least id of equals; record ids join
    verses; undated events go.
    """
    raw = spark.read.schema(_EVENTS).json(events, multiLine=True)
    dated = raw.withColumn("year", timeline.parse_year(F.col("fields.startDate"))).where("year is not null")
    known = places.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("known"))
    records = spark.read.schema(_PLACE_RECORDS).json(place_records, multiLine=True)
    name = F.coalesce("fields.kjvName", "fields.displayTitle")
    resolved = records.withColumn("key", F.lower(name)).join(known, "key", "left").select(F.col("id").alias("record"), name.alias("name"), "known", F.coalesce("known", text.slug(name)).alias("place"), F.col("fields.latitude").try_cast("double").alias("lat"), F.col("fields.longitude").try_cast("double").alias("lon"))
    at = dated.select("id", F.posexplode("fields.locations").alias("ord", "record")).join(resolved, "record").groupBy("id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "place"))), lambda x: x["place"])).alias("places"))
    verse = spark.read.schema(_VERSES).json(verse_records, multiLine=True).select(F.col("id").alias("record"), dot_ref(osis(F.col("fields.osisRef"))).alias("verse"))
    cited = dated.select("id", F.posexplode("fields.verses").alias("ord", "record")).join(verse, "record").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "verse"))), lambda x: x["verse"]).alias("verses"))
    out = dated.select("id", F.col("fields.title").alias("label"), "year").join(at, "id", "left").join(cited, "id", "left")
    made = resolved.where("known is null").groupBy("place").agg(F.min("name").alias("name"), F.first("lat", True).alias("lat"), F.first("lon", True).alias("lon"))
    return out, made


def people_json(people: DataFrame, links: dict[str, str], verses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kin links ``person, role, other`` and verses ``person, verse`` of records ``id, name, <role>: array of ids, verses: array of ids``.

    Others are joined to known people; a person isn't its own kin; repeats go.
    """
    each = [people.select(F.col("id").alias("person"), F.lit(role).alias("role"), F.explode(column).alias("other")) for role, column in links.items()]
    kin = each[0]
    for more in each[1:]:
        kin = kin.unionByName(more)
    kin = kin.where("person <> other").join(people.select(F.col("id").alias("other")), "other", "left_semi").distinct()
    cited = people.select(F.col("id").alias("person"), F.explode("verses").alias("record")).join(verses, "record").select("person", "verse").distinct()
    return kin.select("person", "role", "other"), cited


def also_called(names: Column) -> Column:
    """Other names, cut at commas and trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def people_groups(groups: DataFrame, verses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``slug, name, verses`` of named groups, and how many had blank names."""
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    counts = groups.agg(F.count_if(blank).alias("blank_names"))
    found = groups.where(~blank).select(text.slug(F.col("name")).alias("slug"), F.trim("name").alias("name"), F.explode_outer("verses").alias("record")).join(verses, "record", "left")
    return found.groupBy("slug", "name").agg(F.array_sort(F.collect_set("verse")).alias("verses")), counts


def dictionary(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """``term, text, kind, target`` of entries ``term, text`` with their typed match, if one; empty texts go."""
    trimmed = entries.select(F.trim("term").alias("term"), F.trim("text").alias("text")).where("text <> ''")
    return trimmed.join(matches, "term", "left")


def normalised_kin(links: DataFrame) -> DataFrame:
    """``parent, child, parentage`` from links ``person, role, other``, whichever side told it; curated links aren't touched here."""
    as_parent = links.where("role = 'child'").select(F.col("person").alias("parent"), F.col("other").alias("child"))
    as_child = links.where("role in ('father', 'mother')").select(F.col("other").alias("parent"), F.col("person").alias("child"))
    return as_parent.unionByName(as_child).distinct().withColumn("parentage", F.lit("natural"))


def spouses(links: DataFrame) -> DataFrame:
    """Unordered pairs ``a, b``."""
    return links.where("role = 'spouse'").select(F.least("person", "other").alias("a"), F.greatest("person", "other").alias("b")).distinct()


# ---------------------------------------------------------------- lexicon

def lexicon_entries(entries: DataFrame) -> DataFrame:
    """``id, lang, lemma, senses``: Greek and Hebrew entries with sorted senses; a bad or repeated id is an error."""
    lang = F.when(F.col("id").rlike(r"^G\d{4,5}$"), "grc").when(F.col("id").rlike(r"^H\d{4,5}$"), "hbo")
    checked = entries.withColumn("lang", F.coalesce(lang, F.raise_error(F.concat(F.lit("bad id "), "id")).cast("string")))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    once = checked.withColumn("_n", n).withColumn("lang", F.when(F.col("_n") == 1, F.col("lang")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), "id")).cast("string")))
    return once.select("id", "lang", "lemma", F.array_sort("senses").alias("senses"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """``book, chapter, verse, ord, form, lemma, upos, feats, strong, translit, align`` of token lines.

    The reference line above a token holds for it; nine columns, ``_`` is null;
    the last has ``key=value`` parts, with a number or an unmatched alignment.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "row"))
    ref = F.when(F.startswith("row", F.lit("# ref = ")), F.substring("row", 9, 40))
    held = F.last(ref, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = files.withColumn("ref", held).where(F.col("row").rlike(r"^\d+\t"))
    column = lambda k: F.when(F.split("row", "\t")[k] != "_", F.split("row", "\t")[k])
    wide = rows.withColumn("row", F.when(F.size(F.split("row", "\t")) == 9, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("not nine columns: "), "row")).cast("string")))
    misc = F.str_to_map(F.coalesce(column(8), F.lit("")), F.lit("\\|"), F.lit("="))
    parts = F.split("ref", "\\.")
    return wide.select(
        F.element_at(_book_codes(0), parts[0]).alias("book"),
        parts[1].cast("int").alias("chapter"),
        parts[2].cast("int").alias("verse"),
        column(0).cast("int").alias("ord"),
        column(1).alias("form"),
        column(2).alias("lemma"),
        column(3).alias("upos"),
        column(5).alias("feats"),
        misc["Strong"].alias("strong"),
        misc["Translit"].alias("translit"),
        misc["Align"].alias("align"),
    )


# ---------------------------------------------------------------- marked-up texts: a state machine for each file

_MARK = re.compile(r"<(/?)(\w+)([^>]*?)(/?)>|([^<]+)", re.S)
_KEY = re.compile(r'(\w+)="([^"]*)"')


def quoted_speech(xml: str, who: str = "Jesus") -> list[tuple[int, int, int, str]]:
    """``book, chapter, verse, fragment`` of a speaker's words between milestones; a cut-off tail stops the scan."""
    codes = {short: i for i, (_, short, _) in enumerate(refs.BOOKS)}
    at, open_id, parts, out = None, None, [], []  # open_id: the milestone whose end closes the speech

    def close() -> None:
        if at and parts:
            out.append((*at, " ".join("".join(parts).split())))
        parts.clear()

    for m in _MARK.finditer(xml):
        ends, tag, attrs, _, body = m.groups()
        if body is not None:
            if at and open_id is not None:
                parts.append(unescape(body))
            continue
        keys = dict(_KEY.findall(attrs or ""))
        if tag == "verse":
            close()
            at = None
            if "sID" in keys or "osisID" in keys and not ends:
                book, _, rest = keys.get("osisID", keys.get("sID", "")).partition(".")
                chapter, _, verse = rest.partition(".")
                if book in codes and chapter.isdigit() and verse.isdigit():
                    at = (codes[book], int(chapter), int(verse))
        elif tag == "q" and keys.get("who") == who and "sID" in keys:
            close()
            open_id = keys["sID"]
        elif tag == "q" and open_id is not None and keys.get("eID") == open_id:  # another speaker's end closes nothing
            close()
            open_id = None
    close()
    return out


def red_letters(spark: SparkSession, path: str, who: str = "Jesus") -> DataFrame:
    """``book, chapter, verse, ord, fragment`` of a speaker's words in files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*r[:3], k, r[3]) for xml in frame["value"] for k, r in enumerate(quoted_speech(xml, who))]
            yield pd.DataFrame(rows, columns=["book", "chapter", "verse", "ord", "fragment"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "book int, chapter int, verse int, ord int, fragment string")


_PARAGRAPH = re.compile(r"<(h[1-6]|p)\b[^>]*>(.*?)</\1>", re.S | re.I)
_TAG = re.compile(r"<[^>]+>")
_NUMBER = re.compile(r"^\s*(\d+)(-ans)?[.\]]?\s+")


def numbered_html(page: str) -> list[tuple[str, int, str]]:
    """``heading, paragraph, text``: paragraphs below their headings, numbered by their marks.

    A paragraph without a mark belongs to the one before; numbers that come
    again are counted on.
    """
    from html import unescape

    heading, number, out, seen = "", 0, [], set()
    for tag, inner in _PARAGRAPH.findall(page):
        body = " ".join(unescape(_TAG.sub("", inner)).split())
        if not body:
            continue
        if tag.lower() != "p":
            heading, number = body, 0
            continue
        m = _NUMBER.match(body)
        if m or not out or out[-1][0] != heading:
            number = int(m[1]) if m else number + 1
            while (heading, number) in seen:
                number += 1
            seen.add((heading, number))
            out.append((heading, number, body[m.end() :] if m else body))
        else:
            out[-1] = (heading, out[-1][1], f"{out[-1][2]} {body}")
    return out


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``file, heading, paragraph, text`` of HTML files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, *r) for f, page in zip(frame["file"], frame["value"]) for r in numbered_html(page)]
            yield pd.DataFrame(rows, columns=["file", "heading", "paragraph", "text"])

    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.mapInPandas(run, "file string, heading string, paragraph int, text string")


# ---------------------------------------------------------------- curated tables

#: Keys that curated tables may have, with their types; a key not listed is refused.
CURATED = {
    "event": {"id": str, "label": str, "kind": str, "from_year": int, "to_year": int, "places": list, "verses": list, "order_key": int, "ref_note": str},
    "era": {"id": str, "name": str, "from_year": int, "to_year": int},
    "book": {"code": str, "author": str, "author_ids": list, "write_place": str, "write_from": int, "write_to": int},
    "landmark": {"name": str, "kind": str, "lat": float, "lon": float, "size": int},
    "alias": {"id": str, "name": str, "verses": list},
    "anchor": {"id": str, "event": str, "year": int, "note": str},
    "window": {"book": str, "from_year": int, "to_year": int},
    "source": {"id": str, "title": str, "licence": str, "url": str},
}
_TYPES = {str: "string", int: "int", float: "double", list: "array<string>"}


def curated(spark: SparkSession, toml: str, kind: str) -> DataFrame:
    """The rows of one curated table, from the text of its file; unknown keys, wrong types, zero years and ranges the wrong way round are errors."""
    allowed = CURATED[kind]
    rows = []
    for k, item in enumerate(tomllib.loads(toml).get(kind, [])):
        for key, value in item.items():
            if key not in allowed:
                raise SourceError(f"{kind} {k}: unknown key {key}")
            if allowed[key] is float and isinstance(value, int):
                value = item[key] = float(value)
            if not isinstance(value, allowed[key]):
                raise SourceError(f"{kind} {k}: {key} isn't {allowed[key].__name__}")
        first, last = item.get("from_year"), item.get("to_year", item.get("from_year"))
        if item.get("kind") == "general":
            if first is not None:
                raise SourceError(f"{kind} {k}: a general event has no year")
        elif kind in ("event", "era", "window"):
            if first is None:
                raise SourceError(f"{kind} {k}: no year")
            timeline.check_window(first, last)
        rows.append(tuple([expanded(v) if key == "verses" and v else v for key, v in ((c, item.get(c)) for c in allowed)]))
    return spark.createDataFrame(rows, ", ".join(f"{c} {_TYPES[t]}" for c, t in allowed.items()))


def expanded(verses: list[str]) -> list[str]:
    """Single verses of references such as ``EXO.14.21-31``."""
    out = []
    for v in verses:
        m = re.fullmatch(r"(.+\.)(\d+)-(\d+)", v)
        if m and int(m[2]) >= int(m[3]):
            raise SourceError(f"inverted range {v}")
        out += [f"{m[1]}{n}" for n in range(int(m[2]), int(m[3]) + 1)] if m else [v]
    return out


_HUMAN = re.compile(r"^(?:(\d)\s+)?([A-Za-z ]+?)\s+(\d+)(?::(\d+))?(?:\s*[-–]\s*(\d+)(?::(\d+))?)?$")
_SINGLE = frozenset(refs.BOOK_INDEX[c] for c in ("OBA", "PHM", "2JN", "3JN", "JUD"))


def human_refs(line: str, last_verse: dict[tuple[int, int], int], limit: int = 5000) -> list[tuple[int, int, int]]:
    """Verses of a reference as people write it: ``John 3:16-18, 36``, ``Gen. 1:31–2:3``, ``Psalm 23``, ``Jude 6``.

    The first part between commas has book and chapter; bare parts go on in
    that chapter.  ``last_verse`` has each chapter's length: a verse beyond it,
    an inverted range and a range of over ``limit`` verses are errors.
    """
    out: list[tuple[int, int, int]] = []
    book = chapter = None
    for n, part in enumerate(p.strip().replace(".", "") for p in line.split(",")):
        if n and re.fullmatch(r"\d+(?:\s*[-–]\s*\d+)?", part):
            a, _, b = re.sub(r"\s", "", part).replace("–", "-").partition("-")
            start, end = (chapter, int(a)), (chapter, int(b or a))
        else:
            m = _HUMAN.match(part)
            if not m:
                raise refs.BadRef(f"bad_ref: {part}")
            name = f"{m[1]} {m[2]}" if m[1] else m[2]
            book = refs.CITED_NAMES[name] if name in refs.CITED_NAMES else refs.resolve_book(name)
            c, v, c2, v2 = (int(x) if x else None for x in m.groups()[2:])
            if v is None and book in _SINGLE:
                c, v, c2, v2 = 1, c, None, c2
                start, end = (1, v), (1, v2 or v)
            elif v is None:
                start, end = (c, 1), (c2 or c, last_verse[book, c2 or c])
            elif v2 is not None:
                start, end = (c, v), (c2, v2)
            else:
                start, end = (c, v), (c, c2 or v)
            chapter = end[0]
        if end < start:
            raise refs.BadRef(f"inverted range: {part}")
        at = start
        while at <= end:
            if at[1] > last_verse.get((book, at[0]), 0):
                if at[0] == end[0] or at[1] == 1:
                    raise refs.BadRef(f"no such verse: {at}")
                at = (at[0] + 1, 1)
                continue
            out.append((book, *at))
            if len(out) > limit:
                raise refs.BadRef(f"too long a range: {part}")
            at = (at[0], at[1] + 1)
    return out


def licence_register(sources: DataFrame, licences: DataFrame) -> DataFrame:
    """``kind, key, n``: sources whose key isn't in just one licence row's text, and licence rows that don't have just one source."""
    met = licences.join(F.broadcast(sources), F.contains("text", F.col("id")))  # both are curated by hand
    by_source = sources.join(met.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select(F.lit("source").alias("kind"), F.col("id").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    by_row = licences.select("text").join(met.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "text", "left").select(F.lit("licence").alias("kind"), F.col("text").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    return by_source.unionByName(by_row).where("n <> 1")


def split_provenance(provenance: Column) -> tuple[Column, Column]:
    """Source and locator of ``source[:locator]``."""
    return F.split_part(provenance, F.lit(":"), F.lit(1)), F.nullif(F.regexp_extract(provenance, r"^[^:]*:(.*)$", 1), F.lit(""))

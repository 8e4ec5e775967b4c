"""Scans of small written sources, with the cases that each must drop or refuse."""

from __future__ import annotations

import json

import pytest

from tessera.functions.refs import BadRef
from tessera.sources import readers
from tessera.streaming import events as streams


def test_canon_json(spark, tmp_path):
    canon = {"translation": "T", "books": [{"name": "Genesis", "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "a"}, {"verse": 2, "text": "b"}]}]}, {"name": "1 John", "chapters": [{"chapter": 2, "verses": [{"verse": 3, "text": "c"}]}]}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(canon, indent=1))
    assert sorted(tuple(r) for r in readers.canon_json(spark, str(path)).collect()) == [(0, 1, 1, "a"), (0, 1, 2, "b"), (61, 2, 3, "c")]
    canon["books"][0]["name"] = "Genisis"
    path.write_text(json.dumps(canon))
    with pytest.raises(Exception, match="unknown book Genisis"):
        readers.canon_json(spark, str(path)).collect()


def test_cross_references(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("From\tTo\tVotes\nGen.1.1\tJohn.1.1-John.1.3\t9\nGen.1.1\tGen.1.1\t5\nGen.1.1\tHeb.11.3\t40\nGen.1.1\tNope.1.1\t3\nGen.1.1\tGen.1.1-Gen.1.2\t1\nGen.1.2\tRev.1.1\t-4\n")
    rows, counts = readers.cross_references(spark, str(path))
    assert tuple(counts.head()) == (1, 1, 4)
    first = sorted((r["rank"], r["votes"]) for r in rows.where("from.verse = 1").collect())
    assert first == [(1, 40), (2, 9), (3, 1)]
    known = spark.createDataFrame([(42, 1, 1)], "book int, chapter int, verse int")
    assert [r["votes"] for r in readers.with_known_targets(rows, known).collect()] == [9]


def test_places(spark, tmp_path):
    spot = lambda ll, b: {"resolutions": [{"lonlat": ll, "modern_basis_id": b}]}
    lines = [
        {"friendly_id": "Aphek", "identifications": [spot("35.0,32.0", "m1"), spot("34.9,32.1", "m2")], "modern_associations": {"m1": {"name": "x", "score": 10}, "m2": {"name": "y", "score": 50}}, "verses": [{"osis": "Josh.12.18", "translations": ["esv", "kjv"]}, {"osis": "Josh.12.18", "translations": ["kjv"]}, {"osis": "Gen.1.1", "translations": ["esv"]}, {"osis": "Gen.1.2"}, {"osis": "Bad.1.1", "translations": ["kjv"]}]},
        {"friendly_id": "Aphek", "identifications": [spot("36.0,33.0", "m3")], "modern_associations": {}, "verses": []},
        {"friendly_id": "Nowhere", "identifications": [], "modern_associations": {}, "verses": []},
    ]
    path = tmp_path / "g.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    got = sorted(tuple(r)[:5] for r in readers.places_jsonl(spark, str(path)).collect())
    assert got == [("aphek", "Aphek", 32.1, 34.9, ["JOS.12.18"]), ("aphek-2", "Aphek", 33.0, 36.0, [])]


def test_events(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_text(json.dumps(data))
        return str(tmp_path / name)

    events = put("e.json", [{"id": "r1", "fields": {"title": "Siege", "startDate": "-700", "locations": ["p1", "p2"], "verses": ["v1"]}}, {"id": "r2", "fields": {"title": "Undated"}}])
    records = put("p.json", [{"id": "p1", "fields": {"kjvName": "BETHEL"}}, {"id": "p2", "fields": {"displayTitle": "New Town", "latitude": "1.5", "longitude": "2.5"}}])
    verses = put("v.json", [{"id": "v1", "fields": {"osisRef": "Isa.1.1"}}])
    known = spark.createDataFrame([("bethel", "Bethel"), ("bethel-2", "Bethel")], "id string, name string")
    found, made = readers.events_json(spark, events, records, verses, known)
    assert [tuple(r) for r in found.collect()] == [("r1", "Siege", -701, ["bethel", "new-town"], ["ISA.1.1"])]
    assert [tuple(r) for r in made.collect()] == [("new-town", "New Town", 1.5, 2.5)]


def test_people(spark):
    people = spark.createDataFrame([("a", ["b"], ["x"], ["1", "1", "9"]), ("b", ["b", "zz"], [], [])], "id string, father array<string>, spouse array<string>, verses array<string>")
    kin, cited = readers.people_json(people, {"father": "father", "spouse": "spouse"}, spark.createDataFrame([("1", "GEN.1.1")], "record string, verse string"))
    assert [tuple(r) for r in kin.collect()] == [("a", "father", "b")] and [tuple(r) for r in cited.collect()] == [("a", "GEN.1.1")]
    links = spark.createDataFrame([("c", "father", "p"), ("p", "child", "c"), ("m", "spouse", "p"), ("p", "spouse", "m")], "person string, role string, other string")
    assert [tuple(r) for r in readers.normalised_kin(links).collect()] == [("p", "c", "natural")]
    assert [tuple(r) for r in readers.spouses(links).collect()] == [("m", "p")]
    assert spark.sql("select 'A, B ,,C' as n").select(readers.also_called("n").alias("x")).head()["x"] == ["A", "B", "C"]


def test_lexicon(spark, tmp_path):
    entries = spark.createDataFrame([("G0001", "alpha", ["b", "a"]), ("H0430", "elohim", ["c"])], "id string, lemma string, senses array<string>")
    assert sorted((r["lang"], r["senses"]) for r in readers.lexicon_entries(entries).collect()) == [("grc", ["a", "b"]), ("hbo", ["c"])]
    with pytest.raises(Exception, match="repeated id"):
        readers.lexicon_entries(entries.unionByName(entries)).collect()
    (tmp_path / "a.conllu").write_text("# ref = JHN.1.1\n1\tEn\ten\tADP\t_\t_\t_\t_\tStrong=G1722|Translit=en\n2\tarche\tarche\tNOUN\t_\tCase=Dat\t_\t_\tAlign=unmatched\n\n# ref = JHN.1.2\n1\tHoutos\thoutos\tPRON\t_\t_\t_\t_\tStrong=G3778\n")
    got = sorted(tuple(r) for r in readers.conllu(spark, str(tmp_path / "a.conllu")).collect())
    assert got[0] == (42, 1, 1, 1, "En", "en", "ADP", None, "G1722", "en", None)
    assert got[1][7:] == ("Case=Dat", None, None, "unmatched") and got[2][:4] == (42, 1, 2, 1)


def test_speech():
    xml = '<osis><verse osisID="John.1.38" sID="John.1.38"/>Then <q who="Jesus" sID="q1"/>What seek <i>ye</i>?<q eID="q1"/> They<verse eID="John.1.38"/><verse sID="Nope.1.1"/>x<verse eID="Nope.1.1"/><verse sID="John.1.39"/><q who="Jesus" sID="q2"/>Come &amp; see<q eID="q2"/> and <q who="Peter" sID="q3"/>no<q eID="q3"/>'
    assert readers.quoted_speech(xml) == [(42, 1, 38, "What seek ye?"), (42, 1, 39, "Come & see")]
    nested = '<verse sID="Matt.5.3"/><q who="Jesus" sID="q1"/>Blessed <q who="other" sID="z"/>are<q eID="z"/> you<q eID="q1"/> end'
    assert readers.quoted_speech(nested) == [(39, 5, 3, "Blessed are you")]


def test_numbered_html():
    page = "<h2>Of God</h2><p>1] First &amp; last.</p><p>goes on.</p><p>2] Second.</p><p>2] Again.</p><h2>Of Man</h2><p>Opening.</p>"
    assert readers.numbered_html(page) == [("Of God", 1, "First & last. goes on."), ("Of God", 2, "Second."), ("Of God", 3, "Again."), ("Of Man", 1, "Opening.")]


def test_curated(spark):
    good = '[[event]]\nid = "a"\nlabel = "A"\nfrom_year = -5\nto_year = 3\nverses = ["EXO.14.21-23", "GEN.1.1"]\n'
    assert readers.curated(spark, good, "event").head()["verses"] == ["EXO.14.21", "EXO.14.22", "EXO.14.23", "GEN.1.1"]
    for bad in ('colour = "x"', "from_year = 0", 'label = 4', 'verses = ["GEN.1.5-2"]'):
        with pytest.raises((readers.SourceError, ValueError)):
            readers.curated(spark, f'[[event]]\nid = "a"\n{bad}\n' + ("" if "from_year" in bad else "from_year = 1\n"), "event")
    with pytest.raises(readers.SourceError, match="no year"):
        readers.curated(spark, '[[era]]\nid = "x"\n', "era")
    with pytest.raises(readers.SourceError, match="general"):
        readers.curated(spark, '[[event]]\nid = "x"\nkind = "general"\nfrom_year = 3\n', "event")


def test_human_refs():
    last = {(0, 1): 31, (0, 2): 25, (42, 3): 36, (18, 23): 6, (64, 1): 25}
    assert readers.human_refs("John 3:16-18, 36", last) == [(42, 3, v) for v in (16, 17, 18, 36)]
    assert readers.human_refs("Gen. 1:30–2:2", last) == [(0, 1, 30), (0, 1, 31), (0, 2, 1), (0, 2, 2)]
    assert readers.human_refs("Psalm 23", last) == [(18, 23, v) for v in range(1, 7)]
    assert readers.human_refs("Jude 6", last) == [(64, 1, 6)]
    for bad in ("John 3:40", "John 3:18-16", "Nowhere 3:1", "John 3:16-99"):
        with pytest.raises(BadRef):
            readers.human_refs(bad, last)


def test_register(spark):
    sources = spark.createDataFrame([("geo",), ("lex",), ("none",)], "id string")
    licences = spark.createDataFrame([("the geo data",), ("lex and geo",), ("orphan",)], "text string")
    got = {(r["kind"], r["key"]): r["n"] for r in readers.licence_register(sources, licences).collect()}
    assert got == {("source", "geo"): 2, ("source", "none"): 0, ("licence", "lex and geo"): 2, ("licence", "orphan"): 0}
    a, b = readers.split_provenance(spark.range(1).selectExpr("'src:p.4:x' as p")["p"])
    assert tuple(spark.sql("select 'src:p.4:x' as p").select(*readers.split_provenance("p")).head()) == ("src", "p.4:x") and a is not None and b is not None


def test_streams(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("""select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 20) as ts, id % 2 as user_id, 'view' as event_type, 1.0D as value, '{}' as props
        from range(30)""").write.parquet(folder)
    stream = streams.tumbling(streams.read(spark, folder), "1 hour", "0 seconds")
    query = streams.start(stream, out, str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.agg({"n": "sum"}).head()[0] == 27  # the last hour stays open
    assert streams.sessions(streams.read(spark, folder)).isStreaming
